"""Queries over tracks: cleaning, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import segments, smoothing
from . import views

QUERIES, ORACLE_SQL = {}, {}
K = ["k"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _messy(spark, sf):
    i, v = F.col("event_id") % 7, F.col("value").cast("string")
    text = F.when(i == 0, "").when(i == 1, F.concat(F.lit(" "), v)).when(i == 2, "abc").when(i == 3, "nan").when(i == 4, "-inf").when(i == 5, "-1.7").otherwise(v)
    flag = F.when(i == 0, " True ").when(i == 1, "YES").when(i == 2, "0").when(i == 3, None).otherwise("1")
    return views.table(spark, sf, "events").select("event_id", text.alias("cell"), flag.alias("flag"))


MESSY = """WITH messy AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || CAST(value AS VARCHAR) WHEN 2 THEN 'abc' WHEN 3 THEN 'nan' WHEN 4 THEN '-inf' WHEN 5 THEN '-1.7' ELSE CAST(value AS VARCHAR) END AS cell,
  CASE event_id % 7 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE '1' END AS flag FROM events), parsed AS (SELECT *, try_cast(trim(cell) AS DOUBLE) AS n FROM messy), fin AS (SELECT *, CASE WHEN isnan(n) OR isinf(n) THEN NULL ELSE n END AS finite FROM parsed)"""


@query("prj01_coercion", MESSY + """ SELECT event_id, coalesce(isnan(n), false) AS is_nan, finite, coalesce(CAST(trunc(finite) AS BIGINT), 0) AS whole,
  coalesce(lower(trim(flag)) IN ('1', 'true', 'yes'), false) AS truth, round(finite, 1) AS rounded FROM fin""")
def prj01(spark, sf):
    d = _messy(spark, sf)
    return d.select("event_id", F.coalesce(F.isnan(coerce.number("cell")), F.lit(False)).alias("is_nan"), coerce.finite("cell").alias("finite"), coerce.integer("cell", 0).alias("whole"), coerce.truthy("flag").alias("truth"), coerce.rounded(coerce.finite("cell"), 1).alias("rounded"))


@query("prj06_labels", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '000' ELSE CAST(c_custkey AS VARCHAR) END AS rally_id,
  CASE WHEN c_custkey % 3 <> 0 THEN 'r' || CAST(c_custkey AS VARCHAR) ELSE right(c_name, 12) END AS chart_label, regexp_replace(c_mktsegment || ' / ' || c_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_name,
  printf('%.2f', c_acctbal) AS number_label, CASE WHEN c_custkey % 7200 < 60 THEN CAST(c_custkey % 7200 AS VARCHAR) || ' 秒' WHEN (c_custkey % 7200 + 30) // 60 >= 60 THEN printf('%d 小时 %d 分钟', (c_custkey % 7200 + 30) // 60 // 60, (c_custkey % 7200 + 30) // 60 % 60) ELSE printf('%d 分钟', greatest(1, (c_custkey % 7200 + 30) // 60)) END AS duration_label FROM customer""")
def prj06(spark, sf):
    c = views.table(spark, sf, "customer")
    stem = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("_rally_"), F.col("c_custkey").cast("string")))
    c = c.withColumn("stem", stem)
    return c.select("c_custkey", coerce.rally_id("stem").alias("rally_id"), coerce.chart_label(F.lit(""), "stem").alias("chart_label"), coerce.safe_name(F.concat("c_mktsegment", F.lit(" / "), "c_name")).alias("safe_name"),
                    coerce.number_label("c_acctbal").alias("number_label"), coerce.duration_label(F.col("c_custkey") % 7200).alias("duration_label"))


@query("prj23_missing_fields", """SELECT event_id, list_aggregate(list_filter([CASE WHEN cell = '' THEN 'cell' END, CASE WHEN flag IS NULL THEN 'flag' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS missing FROM ("""
       + MESSY + """ SELECT * FROM messy) WHERE cell = '' OR flag IS NULL""")
def prj23(spark, sf):
    d = _messy(spark, sf).withColumn("m", coerce.missing_fields(["cell", "flag"]))
    return d.where(F.size("m") > 0).select("event_id", F.array_join("m", ",").alias("missing"))


POINTS = "WITH " + views.TRACK + ", p AS (SELECT *, confidence >= 0.4 AS ok, CASE WHEN frame_id % 3 = 0 THEN NULL ELSE x + 1 END AS sx, y + 1 AS sy FROM track)"


@query("prj12_preferred_point", POINTS + " SELECT k, frame_id, CASE WHEN ok AND sx IS NOT NULL THEN sx ELSE x END AS px, CASE WHEN ok AND sx IS NOT NULL THEN sy ELSE y END AS py, CASE WHEN ok THEN sx ELSE x END AS cx, CASE WHEN ok THEN sy ELSE y END AS cy FROM p")
def prj12(spark, sf):
    t = views.track(spark, sf).withColumns({"ok": F.col("confidence") >= 0.4, "sx": F.when(F.col("frame_id") % 3 != 0, F.col("x") + 1), "sy": F.col("y") + 1})
    a, b = coerce.preferred_point("ok", ("sx", "sy"), ("x", "y")), coerce.court_point("ok", ("sx", "sy"), ("x", "y"))
    return t.select("k", "frame_id", a["x"].alias("px"), a["y"].alias("py"), b["x"].alias("cx"), b["y"].alias("cy"))


VALID = "(confidence >= 0.2 AND visibility <> 0)"
_V = "CASE WHEN " + VALID + " THEN frame_id END"
FILLED = f"""{views.TRACK}, ends AS (
  SELECT *, {VALID} AS v, max({_V}) OVER b AS f0, min({_V}) OVER a AS f1 FROM track
  WINDOW b AS (PARTITION BY k ORDER BY frame_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY k ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), gaps AS (
  SELECT e.*, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, NOT e.v AND f1 - f0 - 1 BETWEEN 1 AND 4 AS fits
  FROM ends e LEFT JOIN track p ON p.k = e.k AND p.frame_id = f0 LEFT JOIN track q ON q.k = e.k AND q.frame_id = f1
), filled AS (
  SELECT *, coalesce(fits, false) AS g, CASE WHEN v THEN x WHEN fits THEN x0 + (x1 - x0) * ((frame_id - f0) / (f1 - f0)::DOUBLE) END AS fx,
    CASE WHEN v THEN y WHEN fits THEN y0 + (y1 - y0) * ((frame_id - f0) / (f1 - f0)::DOUBLE) END AS fy FROM gaps
)"""
FILLED80 = FILLED.replace("AS fits\n", "AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 80 AS fits\n").replace(
    "NOT e.v AND f1 - f0 - 1 BETWEEN 1 AND 4 AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 80", "NOT e.v AND f1 - f0 - 1 BETWEEN 1 AND 4 AND sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) <= 80"
)


def _filled(spark, sf, **kw):
    return smoothing.interpolate(views.track(spark, sf), K, ["x", "y"], smoothing.row_is_valid(["x", "y"], 0.2), 4, **kw)


@query("win01_duplicate_frames", "WITH " + views.TRACK + " SELECT k, frame_id, count(*) AS rows FROM frames GROUP BY k, frame_id HAVING count(*) > 1")
def win01(spark, sf):
    e = views.table(spark, sf, "events")
    frame = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 28800).cast("bigint")
    return smoothing.duplicate_frames(e.select(F.col("user_id").alias("k"), frame.alias("frame_id")), K)


@query("win02_gap_interpolation", f"WITH {FILLED} SELECT k, frame_id, round(fx, 6) AS fx, round(fy, 6) AS fy, CAST(g AS INT) AS is_gap_filled FROM filled")
def win02(spark, sf):
    return _filled(spark, sf).select("k", "frame_id", F.round("filled_x", 6).alias("fx"), F.round("filled_y", 6).alias("fy"), "is_gap_filled")


@query("win03_displacement_block", f"WITH {FILLED80} SELECT k, frame_id, round(fx, 6) AS fx, round(fy, 6) AS fy, CAST(g AS INT) AS is_gap_filled FROM filled")
def win03(spark, sf):
    return _filled(spark, sf, max_displacement=80.0).select("k", "frame_id", F.round("filled_x", 6).alias("fx"), F.round("filled_y", 6).alias("fy"), "is_gap_filled")


RUNS = f"""{FILLED}, breaks AS (
  SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w = 1 AND (fx IS NULL) = lag(fx IS NULL) OVER w THEN 0 ELSE 1 END AS b FROM filled WINDOW w AS (PARTITION BY k ORDER BY frame_id)
), runs AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS run FROM breaks)"""
MEDIANS = RUNS + """, medians AS (
  SELECT *, CASE WHEN fx IS NOT NULL THEN median(fx) OVER w END AS mx, CASE WHEN fy IS NOT NULL THEN median(fy) OVER w END AS my
  FROM runs WINDOW w AS (PARTITION BY k, run ORDER BY frame_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
)"""
SMOOTHED = MEDIANS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY frame_id) AS n FROM medians WHERE mx IS NOT NULL
), folded AS (
  SELECT k, run, frame_id, n, mx AS sx, my AS sy FROM numbered WHERE n = 1
  UNION ALL SELECT a.k, a.run, a.frame_id, a.n, 0.35::DOUBLE * a.mx + (1 - 0.35::DOUBLE) * f.sx, 0.35::DOUBLE * a.my + (1 - 0.35::DOUBLE) * f.sy FROM folded f JOIN numbered a ON a.k = f.k AND a.run = f.run AND a.n = f.n + 1
)"""


@query("win04_run_median", f"WITH {MEDIANS} SELECT k, frame_id, round(mx, 9) AS mx, round(my, 9) AS my FROM medians")
def win04(spark, sf):
    d = smoothing.contiguous_runs(_filled(spark, sf), K, "filled_x")
    for c in "xy":
        d = smoothing.rolling_median(d, K, f"filled_{c}", 5, f"m{c}")
    return d.select("k", "frame_id", F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"))


@query("win05_ema_reset", f"WITH RECURSIVE {SMOOTHED} SELECT k, frame_id, round(sx + 1e-10, 6) AS sx, round(sy + 1e-10, 6) AS sy FROM folded")
def win05(spark, sf):
    d = smoothing.smooth(views.track(spark, sf), K, ["x", "y"]).where("is_smoothed_valid = 1")
    return d.select("k", "frame_id", F.round(F.col("smoothed_x") + 1e-10, 6).alias("sx"), F.round(F.col("smoothed_y") + 1e-10, 6).alias("sy"))


@query("win06_contiguity_runs", f"WITH {RUNS} SELECT k, CAST(run AS BIGINT) AS run, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS rows, count(fx) AS filled FROM runs GROUP BY k, run")
def win06(spark, sf):
    d = smoothing.contiguous_runs(_filled(spark, sf), K, "filled_x")
    return d.groupBy("k", "run").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("rows"), F.count("filled_x").alias("filled"))


@query("agg15_smoothing_summary", f"WITH {FILLED80} SELECT k, count(*) AS total_rows, CAST(sum(CAST(v AS INT)) AS BIGINT) AS source_valid_rows, CAST(sum(CAST(g AS INT)) AS BIGINT) AS gap_filled_rows, count(fx) AS smoothed_valid_rows FROM filled GROUP BY k")
def agg15(spark, sf):
    valid = smoothing.row_is_valid(["x", "y"], 0.2)
    return smoothing.smoothing_summary(smoothing.smooth(views.track(spark, sf), K, ["x", "y"], max_displacement=80.0), K, valid)


@query("win30_trail", "WITH " + views.TRACK + """, t AS (SELECT *, sum(1 - visibility) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM track)
SELECT k, frame_id, coalesce(list_aggregate(list(CASE WHEN visibility = 1 THEN CAST(frame_id AS VARCHAR) END) FILTER (visibility = 1) OVER (PARTITION BY k, i ORDER BY frame_id ROWS 4 PRECEDING), 'string_agg', ','), '') AS trail FROM t""")
def win30(spark, sf):
    d = smoothing.trail(views.track(spark, sf), K, F.col("visibility") == 1, F.col("frame_id").cast("string"), 5)
    return d.select("k", "frame_id", F.array_join("trail", ",").alias("trail"))


@query("win09_segments", "WITH " + views.SAMPLES + """, m AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY k ORDER BY frame_id) > 3 THEN 1 ELSE 0 END AS b FROM samples WHERE is_main_view),
i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM m), g AS (SELECT k, i, min(frame_id) AS start_frame, max(frame_id) + 1 AS end_frame, count(*) AS frame_count, round(avg(main_view_score), 9) AS main_view_score FROM i GROUP BY k, i)
SELECT k, printf('%03d', row_number() OVER (PARTITION BY k ORDER BY start_frame)) AS segment_id, start_frame, end_frame, frame_count, main_view_score FROM g WHERE end_frame - start_frame >= 2""")
def win09(spark, sf):
    d = segments.segments(views.samples(spark, sf), K, F.col("is_main_view"), 1, 2, 2, {"main_view_score": "main_view_score"})
    return d.select("k", "segment_id", "start_frame", "end_frame", "frame_count", F.round("main_view_score", 9).alias("main_view_score"))


@query("win10_rejected_runs", "WITH " + views.SAMPLES + """, s AS (SELECT *, NOT is_main_view AND main_view_score >= 0.1 AS r FROM samples), i AS (SELECT *, sum(1 - CAST(r AS INT)) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM s),
c AS (SELECT k, i, reject_reason, count(*) AS n FROM i WHERE r AND reject_reason <> '' GROUP BY ALL), m AS (SELECT k, i, reject_reason FROM c QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY n DESC, reject_reason) = 1),
g AS (SELECT k, i, min(frame_id) AS start_frame, max(frame_id) + 1 AS end_frame, avg(main_view_score) AS score FROM i WHERE r GROUP BY k, i)
SELECT k, printf('R%03d', row_number() OVER (PARTITION BY k ORDER BY start_frame)) AS segment_id, start_frame, end_frame, coalesce(reject_reason, 'low_main_view_score') AS reject_reason, round(score, 9) AS score FROM g LEFT JOIN m USING (k, i)""")
def win10(spark, sf):
    d = segments.rejected_runs(views.samples(spark, sf), K, ~F.col("is_main_view") & (F.col("main_view_score") >= 0.1), 1, "reject_reason", "main_view_score")
    return d.select("k", "segment_id", "start_frame", "end_frame", "reject_reason", F.round("score", 9).alias("score"))


DECIDED = "WITH " + views.SAMPLES + """, a AS (SELECT DISTINCT k, frame_id FROM samples WHERE main_view_score >= 0.2), b AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY k ORDER BY frame_id) - 1 > 2 THEN 1 ELSE 0 END AS b FROM a),
i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM b), g AS (SELECT k, i, min(frame_id) AS f, max(frame_id) AS l, count(*) AS evidence_count FROM i GROUP BY k, i),
e AS (SELECT *, least(90, l + 1 + 1, coalesce(lead(f) OVER (PARTITION BY k ORDER BY f), 90)) AS end_frame FROM g), s AS (SELECT *, greatest(0, f - 2, coalesce(lag(end_frame) OVER (PARTITION BY k ORDER BY f), 0)) AS start_frame FROM e),
r AS (SELECT *, CASE WHEN evidence_count < 2 THEN 'insufficient_active_samples' WHEN end_frame - start_frame < 5 THEN 'below_min_rally_duration' WHEN end_frame - start_frame > 20 THEN 'above_max_rally_duration' ELSE 'active_play_evidence' END AS reason FROM s WHERE end_frame > start_frame)
"""


@query("win12_rally_decisions", DECIDED + "SELECT k, printf('C%03d', row_number() OVER (PARTITION BY k ORDER BY start_frame)) AS candidate_id, start_frame, end_frame, CASE WHEN reason = 'active_play_evidence' THEN 'accepted' ELSE 'rejected' END AS status, reason, evidence_count FROM r")
def win12(spark, sf):
    return segments.rally_decisions(views.samples(spark, sf), K, F.col("main_view_score") >= 0.2, 1, 2, 2, 1, 0, 90, 5, 20, 2)


@query("win14_shot_merge", "WITH " + views.SAMPLES + """, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n FROM samples), v AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY k ORDER BY frame_id) - 1 > 1 THEN 1 ELSE 0 END AS b FROM n WHERE is_main_view),
i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM v) SELECT k, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS samples FROM i GROUP BY k, i""")
def win14(spark, sf):
    return segments.shot_runs(views.samples(spark, sf), K, F.col("is_main_view"), 1)


INTERVALS = "iv AS (SELECT * FROM (SELECT l_orderkey AS k, CAST(l_linenumber * 7 + l_quantity % 5 AS DOUBLE) AS s, CAST(l_linenumber * 7 + l_quantity % 5 + l_quantity % 11 AS DOUBLE) AS e, max(l_discount) AS confidence FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY e DESC) = 1)"


@query("win15_interval_merge", f"WITH {INTERVALS}, j AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY k ORDER BY s) > 1.5 THEN 1 ELSE 0 END AS b FROM iv WHERE e - s >= 1), i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s) AS i FROM j) "
       'SELECT k, min(s) AS "start", max_by(e, s) AS "end", max(confidence) AS confidence, count(*) AS parts FROM i GROUP BY k, i')
def win15(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    start = (n * 7 + q % 5).cast("double")
    rows = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + q % 11).cast("double").alias("end"), F.col("l_discount").alias("confidence"))
    longest = rows.groupBy("k", "start").agg(F.max(F.struct("end", "confidence")).alias("m")).select("k", "start", F.col("m.end").alias("end"), F.col("m.confidence").alias("confidence"))
    return segments.merge_intervals(longest, K, 1.0, 1.5)


@query("win29_gap_split", "WITH " + views.TRACK + """, j AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY k ORDER BY frame_id) > 3 THEN 1 ELSE 0 END AS b FROM track), i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM j),
g AS (SELECT k, i, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS rows FROM i GROUP BY k, i HAVING count(*) >= 4) SELECT k, start_frame, end_frame, rows, row_number() OVER (PARTITION BY k ORDER BY start_frame) AS part FROM g""")
def win29(spark, sf):
    d = segments.gap_split(views.track(spark, sf), K, 3, 4)
    return d.withColumn("part", F.col("part").cast("bigint"))


@query("str02_hysteresis", "WITH " + views.SAMPLES + """, c AS (SELECT *, main_view_score >= 0.2 AS f FROM samples), d AS (SELECT *, CASE WHEN f <> lag(f) OVER (PARTITION BY k ORDER BY frame_id) THEN 1 ELSE 0 END AS b FROM c), i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY frame_id) AS p FROM i), s AS (SELECT *, coalesce(last_value(CASE WHEN p = 3 THEN f END IGNORE NULLS) OVER (PARTITION BY k ORDER BY frame_id ROWS UNBOUNDED PRECEDING), false) AS is_open FROM p),
o AS (SELECT *, is_open AND NOT coalesce(lag(is_open) OVER (PARTITION BY k ORDER BY frame_id), false) AS o FROM s) SELECT k, frame_id, is_open, CAST(sum(CAST(o AS INT)) OVER (PARTITION BY k ORDER BY frame_id) AS BIGINT) AS session FROM o""")
def str02(spark, sf):
    return segments.hysteresis(views.samples(spark, sf), K, F.col("main_view_score") >= 0.2, 3).select("k", "frame_id", "is_open", "session")


IV2 = "iv AS (SELECT k, start_frame, end_frame FROM r WHERE reason = 'active_play_evidence')"


@query("joi07_interval_filter", DECIDED.rstrip() + f", {IV2} SELECT s.k, s.frame_id, iv.start_frame, iv.end_frame FROM samples s JOIN iv ON iv.k = s.k AND s.frame_id >= iv.start_frame AND s.frame_id < iv.end_frame")
def joi07(spark, sf):
    iv = win12(spark, sf).where("status = 'accepted'").select("k", "start_frame", "end_frame")
    return segments.within_intervals(views.samples(spark, sf), iv, K).select("k", "frame_id", "start_frame", "end_frame")


@query("joi08_latest_before", DECIDED.rstrip() + f""", {IV2}, n AS (SELECT s.k, s.frame_id, iv.start_frame, iv.end_frame FROM samples s JOIN iv ON iv.k = s.k AND iv.start_frame <= s.frame_id AND iv.end_frame <= s.frame_id + 2 AND s.frame_id - iv.end_frame <= 6 WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY s.k, s.frame_id ORDER BY iv.end_frame DESC, iv.start_frame DESC) = 1) SELECT * FROM n QUALIFY NOT coalesce(lag(start_frame) OVER (PARTITION BY k ORDER BY frame_id) = start_frame AND lag(end_frame) OVER (PARTITION BY k ORDER BY frame_id) = end_frame, false)""")
def joi08(spark, sf):
    iv = win12(spark, sf).where("status = 'accepted'").select("k", "start_frame", "end_frame")
    changes = views.samples(spark, sf).where("event_type = 'purchase'").select("k", "frame_id")
    return segments.latest_before(changes, iv, K, 2, 6)


@query("src19_frame_index", DECIDED.rstrip() + f", {IV2} SELECT k, row_number() OVER (PARTITION BY k ORDER BY start_frame, f) - 1 AS clean_frame_id, f AS original_frame_id FROM (SELECT k, start_frame, unnest(range(start_frame, end_frame)) AS f FROM iv)")
def src19(spark, sf):
    return segments.frame_index(win12(spark, sf).where("status = 'accepted'"), K)


@query("cal13_activity_flags", "WITH " + views.SAMPLES + " SELECT k, frame_id, x >= 10 AND y >= 20 AS is_rally_view, main_view_score >= 0.2 AS is_court_view, x >= 10 AND y >= 20 AND main_view_score >= 0.2 AND confidence BETWEEN 0.3 AND 0.95 AS is_candidate FROM samples")
def cal13(spark, sf):
    rally, court = (F.col("x") >= 10) & (F.col("y") >= 20), F.col("main_view_score") >= 0.2
    return views.samples(spark, sf).select("k", "frame_id", rally.alias("is_rally_view"), court.alias("is_court_view"), (rally & court & F.col("confidence").between(0.3, 0.95)).alias("is_candidate"))
