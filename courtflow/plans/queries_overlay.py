"""Own entries of what overlays, reports and runs show, and of the table queries behind them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import geometry as g
from ..operators import descriptors, evaluation, events, metadata, movement, overlay, seams, segments, smoothing, tracking
from ..sources import tables
from . import views
from .queries_more import EV, FOOT, _events
from .queries_play import K, MERGED, _r, _scored, r
from .queries_tracks import DECIDED, win12

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


T = "WITH " + views.TRACK
P = "WITH " + views.PLAYER


# ---- lookups at a frame

@query("joi18_rally_groups", P + " SELECT CASE WHEN event_id % 9 = 0 THEN '' ELSE 'v' || CAST(k % 3 AS VARCHAR) END AS video_stem, rally_id, count(*) AS rows FROM player GROUP BY ALL")
def joi18(spark, sf):
    p = views.player(spark, sf).withColumn("video_stem", F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("v"), (F.col("k") % 3).cast("string"))))
    return overlay.rally_sizes(p)


ACTIVE = T + ", a AS (SELECT t.k, t.frame_id, e.event_id, e.frame_id AS candidate_frame FROM track t JOIN track e ON e.k = t.k AND abs(t.frame_id - e.frame_id) <= 2 WHERE e.event_type = 'purchase')"


@query("joi20_active_events", ACTIVE + " SELECT k, frame_id, event_id FROM a QUALIFY row_number() OVER (PARTITION BY k, frame_id ORDER BY candidate_frame DESC, event_id DESC) = 1")
def joi20(spark, sf):
    t = views.track(spark, sf)
    e = t.where("event_type = 'purchase'").select("k", "event_id", F.col("frame_id").alias("candidate_frame"))
    return overlay.active_events(t.select("k", "frame_id"), e, K, 2, ["candidate_frame", "event_id"]).select("k", "frame_id", "event_id")


@query("joi20_active_phases", T + " SELECT t.k, t.frame_id, e.event_id FROM track t JOIN track e ON e.k = t.k AND t.frame_id >= e.frame_id - 1 AND t.frame_id < e.frame_id + 3 WHERE e.event_type = 'signup' AND e.event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY t.k, t.frame_id ORDER BY e.frame_id, e.event_id) = 1")
def joi20b(spark, sf):
    t = views.track(spark, sf)
    e = t.where("event_type = 'signup'").select("k", "event_id", (F.col("frame_id") - 1).alias("start_frame"), (F.col("frame_id") + 3).alias("end_frame"), F.when(F.col("event_id") % 3 != 0, "eligible").otherwise("not_eligible").alias("phase_eligibility"))
    return overlay.active_phases(t.select("k", "frame_id"), e, K, ["start_frame", "event_id"]).select("k", "frame_id", "event_id")


@query("joi21_frame_lookup", T + " SELECT frame_id, k, x FROM track WHERE visibility = 1 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY k DESC, event_id DESC) = 1")
def joi21(spark, sf):
    t = views.track(spark, sf).where("visibility = 1").select("frame_id", "k", "x", "event_id")
    return overlay.last_by(t, ["frame_id"], ["k", "event_id"]).drop("event_id")


@query("joi22_player_lookup", P + " SELECT frame_id, player_id, k FROM player QUALIFY row_number() OVER (PARTITION BY frame_id, player_id ORDER BY k DESC) = 1")
def joi22(spark, sf):
    return overlay.last_by(views.player(spark, sf).select("frame_id", "player_id", "k"), ["frame_id", "player_id"], ["k"])


@query("joi05_phase_windows", f"WITH {EV} SELECT ev.k, ev.event_id, count(t.frame_id) AS rows, count(*) FILTER (t.visibility = 1) AS seen FROM ev LEFT JOIN track t ON t.k = ev.k AND t.frame_id >= w0 AND t.frame_id < w1 GROUP BY ALL")
def joi05(spark, sf):
    e = _events(spark, sf)
    d = descriptors.window_rows(e, views.track(spark, sf).select("k", "frame_id", "visibility"), K).groupBy("k", "event_id").agg(F.count("*").alias("rows"), F.count_if(F.col("visibility") == 1).alias("seen"))
    return e.select("k", "event_id").join(d, ["k", "event_id"], "left").select("k", "event_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("seen", F.lit(0)).alias("seen"))


@query("joi06_input_coverage", f"""WITH {EV}, p AS (SELECT *, CASE WHEN x % 13.40::DOUBLE >= 6.7::DOUBLE THEN 'near' ELSE 'far' END AS player_id FROM track)
SELECT ev.k, ev.event_id, {r('count(DISTINCT p.frame_id) FILTER (player_id = who) / any_value(w1 - w0)', 'own')}, {r('count(DISTINCT p.frame_id) FILTER (player_id <> who) / any_value(w1 - w0)', 'opponent')}, {r('count(DISTINCT p.frame_id) FILTER (visibility = 1) / any_value(w1 - w0)', 'shuttle')}
FROM (SELECT *, CASE WHEN c % 2 = 0 THEN 'near' ELSE 'far' END AS who FROM ev) ev LEFT JOIN p ON p.k = ev.k AND p.frame_id >= w0 AND p.frame_id < w1 GROUP BY ev.k, ev.event_id""")
def joi06(spark, sf):
    p = views.player(spark, sf)
    e = _events(spark, sf).withColumn("player_id", F.when(F.col("candidate_frame") % 2 == 0, "near").otherwise("far"))
    d = overlay.input_coverage(e, p.select("k", "frame_id", "player_id"), p.where("visibility = 1").select("k", "frame_id"), K)
    return d.select("k", "event_id", _r("own"), _r("opponent"), _r("shuttle"))


# ---- markers, texts, panels

@query("sup01_markers", T + " SELECT k, frame_id, CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0 THEN x + 1 ELSE x END AS mx FROM track")
def sup01(spark, sf):
    e = F.col("event_id")
    body = F.struct(F.when(e % 4 != 0, F.col("x") + 1).alias("x"), F.col("y").alias("y"))
    m = overlay.marker(body, F.when(e % 5 == 0, "0").otherwise("1"), F.struct("x", "y"))
    return views.track(spark, sf).select("k", "frame_id", m["x"].alias("mx"))


@query("sup02_overlay_court_points", P + " SELECT rally_id, frame_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN court_x + 1 ELSE court_x END AS x FROM player")
def sup02(spark, sf):
    e = F.col("event_id")
    p = views.player(spark, sf).withColumns({"sx": F.when(e % 3 != 0, F.col("court_x") + 1), "sy": F.col("court_y")})
    return p.select("rally_id", "frame_id", coerce.preferred_point(e % 2 == 0, ("sx", "sy"), ("court_x", "court_y"))["x"].alias("x"))


@query("sup04_rescaled", T + f" SELECT k, frame_id, {r('x * 1.5::DOUBLE', 'px')}, {r('y * 0.75::DOUBLE', 'py')} FROM track")
def sup04(spark, sf):
    x, y = g.rescaled(F.col("x"), F.col("y"), (1280, 960), (1920, 720))
    return views.track(spark, sf).select("k", "frame_id", x.alias("px"), y.alias("py")).select("k", "frame_id", _r("px"), _r("py"))


@query("sup05_summary_text", "SELECT o_orderkey, 'near: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'movement N/A' ELSE CASE WHEN o_orderkey % 5 = 0 THEN '0.0m' ELSE printf('%.1fm', (o_custkey % 50) + 0.5) END || printf('  %.1fm/s', o_custkey % 7 + 0.0) END || '  ' || CASE WHEN o_orderkey % 4 = 0 THEN 'events N/A' ELSE 'reversal candidates ' || CAST(o_custkey % 4 AS VARCHAR) END AS text FROM orders")
def sup05(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    not_ = lambda n: F.when(o % n == 0, "not_eligible").otherwise("eligible")
    text = overlay.summary_text(F.lit("near"), not_(3), F.when(o % 5 != 0, c % 50 + 0.5), (c % 7).cast("double"), not_(4), c % 4)
    return views.table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query("sup06_last_frame", T + " SELECT k, max(frame_id) AS frame_id FROM track GROUP BY k")
def sup06(spark, sf):
    return overlay.on_last_frame(views.track(spark, sf).select("k", "frame_id"), K)


@query("sup07_panel_counts", P + ", s AS (SELECT rally_id, court_x * 1.2::DOUBLE AS x, court_y AS y FROM player) SELECT rally_id, count(*) FILTER (x BETWEEN 0 AND 6.10 AND y BETWEEN 0 AND 13.40) AS shown, count(*) FILTER (NOT (x BETWEEN 0 AND 6.10 AND y BETWEEN 0 AND 13.40)) AS rejected, CAST(min(20 + round(x / 6.10::DOUBLE * 100)) FILTER (x BETWEEN 0 AND 6.10 AND y BETWEEN 0 AND 13.40) AS INT) AS leftmost FROM s GROUP BY rally_id")
def sup07(spark, sf):
    p = views.player(spark, sf).select("rally_id", (F.col("court_x") * 1.2).alias("x"), F.col("court_y").alias("y"))
    return overlay.panel(p, ["rally_id"], "x", "y", 20, 38, 100, 220)


@query("sup08_court_markings", "SELECT name, CAST(round(10 + x1::DOUBLE / 6.1::DOUBLE * 122) AS INT) AS px, CAST(round(38 + y2::DOUBLE / 13.4::DOUBLE * 268) AS INT) AS py FROM (VALUES ('far_baseline', 0, 0), ('near_baseline', 6.1, 13.4), ('far_short_service', 0, 4.72), ('near_short_service', 0, 8.68), ('net', 0, 6.7), ('left_singles_sideline', 0.46, 13.4)) AS m(name, x1, y2)")
def sup08(spark, sf):
    wanted = {"far_baseline", "near_baseline", "far_short_service", "near_short_service", "net", "left_singles_sideline"}
    rows = [(n, x1, y2) for n, x1, _, _, y2, _ in g.COURT_LINES if n in wanted]
    d = spark.createDataFrame(rows, "name string, x double, y double")
    return d.select("name", F.round(10 + F.col("x") / 6.1 * 122).cast("int").alias("px"), F.round(38 + F.col("y") / 13.4 * 268).cast("int").alias("py"))


@query("sup09_grouped_rows", P + " SELECT player_id, rally_id, array_to_string(list_sort(list(frame_id))[1:3], ',') AS first_frames FROM player GROUP BY ALL")
def sup09(spark, sf):
    d = views.player(spark, sf).groupBy("player_id", "rally_id").agg(F.slice(F.sort_array(F.collect_list("frame_id")), 1, 3).alias("f"))
    return d.select("player_id", "rally_id", F.array_join("f", ",").alias("first_frames"))


@query("sup10_public_columns", T + " SELECT k, frame_id, round(x / 7, 3) AS speed FROM track")
def sup10(spark, sf):
    return overlay.public(views.track(spark, sf).select("k", "frame_id", (F.col("x") / 7).alias("speed"), F.col("y").alias("_samples")))


@query("sup11_means", T + f" SELECT k, {r('avg(x) FILTER (visibility = 0)', 'hidden_mean')}, {r('avg(CASE WHEN confidence >= 0.5 THEN x END)', 'sure_mean')} FROM track GROUP BY k")
def sup11(spark, sf):
    d = views.track(spark, sf).withColumns({"hidden": F.when(F.col("visibility") == 0, F.col("x")), "sure": F.when(F.col("confidence") >= 0.5, F.col("x"))})
    d = d.groupBy("k").agg(evaluation.null_aware("hidden")[0], evaluation.null_aware("sure")[0])
    return d.select("k", _r("hidden_mean"), _r("sure_mean"))


@query("sup12_null_skipping_mean", T + f" SELECT k, event_type, {r('avg(CASE WHEN event_id % 3 > 0 THEN y END)', 'y_mean')} FROM track GROUP BY ALL")
def sup12(spark, sf):
    d = views.track(spark, sf).withColumn("y", F.when(F.col("event_id") % 3 > 0, F.col("y")))
    return d.groupBy("k", "event_type").agg(evaluation.null_aware("y")[0]).select("k", "event_type", _r("y_mean"))


@query("sup22_rows_by_video", T + " SELECT k % 7 AS video, count(*) AS rows, count(DISTINCT k) AS tracks FROM track GROUP BY 1")
def sup22(spark, sf):
    return views.track(spark, sf).withColumn("video", F.col("k") % 7).groupBy("video").agg(F.count("*").alias("rows"), F.countDistinct("k").alias("tracks"))


@query("sup24_rows_by_rally", P + " SELECT rally_id, count(*) AS rows, count(*) FILTER (player_id = 'near') AS near_rows, count(*) FILTER (player_id = 'far') AS far_rows FROM player GROUP BY rally_id")
def sup24(spark, sf):
    return views.player(spark, sf).groupBy("rally_id").agg(F.count("*").alias("rows"), *(F.count_if(F.col("player_id") == p).alias(f"{p}_rows") for p in ("near", "far")))


@query("sup26_track_ends", T + " SELECT k, count(*) AS points, arg_min(x, frame_id) AS start_x, arg_min(y, frame_id) AS start_y, arg_max(x, frame_id) AS end_x, arg_max(y, frame_id) AS end_y FROM track WHERE visibility = 1 GROUP BY k")
def sup26(spark, sf):
    return overlay.ends(views.track(spark, sf).where("visibility = 1"), K)


@query("sup28_last_summary", T + " SELECT k, CASE WHEN event_id % 4 = 0 THEN 0 ELSE frame_id END::DOUBLE AS track_rows FROM track QUALIFY row_number() OVER (PARTITION BY k ORDER BY frame_id DESC) = 1")
def sup28(spark, sf):
    t = views.track(spark, sf).select("k", "frame_id", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("frame_id").cast("string")).alias("track_rows"))
    return overlay.clamped_totals(t, "k", ["track_rows"], ["frame_id"])


@query("sup34_decision_rows", DECIDED + "SELECT k, printf('C%03d', row_number() OVER (PARTITION BY k ORDER BY start_frame)) AS candidate_id, start_frame, end_frame, CASE WHEN reason = 'active_play_evidence' THEN 'accepted' ELSE 'rejected' END AS status FROM r")
def sup34(spark, sf):
    d = win12(spark, sf)
    n = F.row_number().over(Window.partitionBy("k").orderBy("start_frame"))
    return d.select("k", F.format_string("C%03d", n).alias("candidate_id"), "start_frame", "end_frame", "status")


@query("sup43_point_in_mask", T + " SELECT k, frame_id, x BETWEEN 10 AND 90 AND y BETWEEN 20 AND 80 AS inside, x BETWEEN 5 AND 95 AND y BETWEEN 15 AND 85 AS inside_with_margin FROM track")
def sup43(spark, sf):
    quad = [(10, 20), (90, 20), (90, 80), (10, 80)]
    x, y = F.col("x"), F.col("y")
    return views.track(spark, sf).select("k", "frame_id", overlay.in_polygon(x, y, quad).alias("inside"), overlay.in_polygon(x, y, quad, 5.0).alias("inside_with_margin"))


@query("trk20_court_mask", T + " SELECT k, frame_id FROM track WHERE y >= 10 AND y <= 90 AND x >= y / 4 AND x <= 100 - y / 4")
def trk20(spark, sf):
    """A court seen in perspective."""
    quad = [(2.5, 10), (97.5, 10), (77.5, 90), (22.5, 90)]
    t = views.track(spark, sf)
    return t.where(overlay.in_polygon(F.col("x"), F.col("y"), quad)).select("k", "frame_id")


@query("sup45_representative_frame", T + " SELECT k, frame_id FROM (SELECT * FROM track QUALIFY row_number() OVER (PARTITION BY k ORDER BY frame_id) <= 5) QUALIFY row_number() OVER (PARTITION BY k ORDER BY x DESC, frame_id) = 1")
def sup45(spark, sf):
    first = views.track(spark, sf).withColumn("n", F.row_number().over(smoothing.by_frame(K))).where("n <= 5")
    return first.groupBy("k").agg(F.max_by("frame_id", F.struct(F.col("x"), (-F.col("frame_id")))).alias("frame_id"))


@query("sup46_batch_status", T + ", v AS (SELECT k % 11 AS video, count(*) FILTER (event_type = 'error') AS failed, count(*) AS runs FROM track GROUP BY 1) SELECT video, runs, failed, CASE WHEN failed > 0 THEN 2 ELSE 0 END AS exit_code FROM v")
def sup46(spark, sf):
    d = views.track(spark, sf).withColumn("video", F.col("k") % 11)
    return metadata.batch_status(d, ["video"], F.col("event_type") == "error")


@query("sup52_stage_list", T + " SELECT k, string_agg(event_type || ':' || CASE WHEN visibility = 1 THEN 'success' ELSE 'failed' END, ' ' ORDER BY frame_id) AS stages FROM track WHERE frame_id < 20 GROUP BY k")
def sup52(spark, sf):
    t = views.track(spark, sf).where("frame_id < 20").select("k", "frame_id", F.concat("event_type", F.lit(":"), F.when(F.col("visibility") == 1, "success").otherwise("failed")).alias("s"))
    return metadata.stage_list(t, K, "frame_id", "s")


@query("sup54_existing_outputs", "SELECT c_custkey, array_to_string(list_filter(['a.csv', 'b.json', 'c.mp4'], lambda f: c_custkey % 2 = 0 OR f <> 'b.json'), ' ') AS files FROM customer")
def sup54(spark, sf):
    there = F.when(F.col("c_custkey") % 2 == 0, F.array(*map(F.lit, ("b.json", "a.csv", "c.mp4")))).otherwise(F.array(*map(F.lit, ("c.mp4", "a.csv"))))
    return views.table(spark, sf, "customer").select("c_custkey", F.array_join(metadata.existing(["a.csv", "b.json", "c.mp4"], there), " ").alias("files"))


@query("sup55_rally_default", T + " SELECT CASE WHEN event_id % 6 = 0 THEN '000' ELSE lpad(CAST(k AS VARCHAR), 3, '0') END AS rally_id, count(*) AS rows FROM track GROUP BY 1")
def sup55(spark, sf):
    t = views.track(spark, sf).withColumn("rally_id", F.when(F.col("event_id") % 6 == 0, "").otherwise(F.lpad(F.col("k").cast("string"), 3, "0")))
    return t.groupBy(F.coalesce(F.nullif("rally_id", F.lit("")), F.lit("000")).alias("rally_id")).agg(F.count("*").alias("rows"))


@query("sup61_padded_roi", T + " SELECT k, frame_id, x >= 16 AND x <= 84 AND y >= 25.2::DOUBLE AND y <= 74.8::DOUBLE AS inside FROM track")
def sup61(spark, sf):
    x, y = F.col("x"), F.col("y")
    return views.track(spark, sf).select("k", "frame_id", g.in_padded_roi(x, y, (20.0, 29.0, 80.0, 71.0), pad_x=4.0, pad_y=3.8).alias("inside"))


@query("sup63_persons", T + f" SELECT k, frame_id, {r('x + 5', 'foot_x')}, {r('y + 10', 'foot_y')} FROM track WHERE x > 1 AND y > 1")
def sup63(spark, sf):
    left, right = F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 10).alias("x"), F.col("y").alias("y"))
    t = views.track(spark, sf).withColumn("foot", tracking.person_foot(left, right)).where("foot is not null")
    return t.select("k", "frame_id", F.col("foot.x").alias("foot_x"), F.col("foot.y").alias("foot_y")).select("k", "frame_id", _r("foot_x"), _r("foot_y"))


@query("sup66_rally_scatter", P + " SELECT rally_id, player_id, count(*) AS points, round(avg(court_x) + 1e-10::DOUBLE, 4) AS mean_x, round(avg(court_y) + 1e-10::DOUBLE, 4) AS mean_y FROM player WHERE visibility = 1 GROUP BY ALL HAVING count(*) >= 3")
def sup66(spark, sf):
    d = views.player(spark, sf).where("visibility = 1").groupBy("rally_id", "player_id").agg(F.count("*").alias("points"), F.avg("court_x").alias("mean_x"), F.avg("court_y").alias("mean_y"))
    return d.where("points >= 3").select("rally_id", "player_id", "points", _r("mean_x", 4), _r("mean_y", 4))


@query("sup67_recency_radius", T + " SELECT k, frame_id, round(2 + 6 * (n - 1) / greatest(1, c - 1), 4) AS radius FROM (SELECT k, frame_id, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n, count(*) OVER (PARTITION BY k) AS c FROM track)")
def sup67(spark, sf):
    n, c = F.row_number().over(smoothing.by_frame(K)), F.count("*").over(Window.partitionBy("k"))
    return views.track(spark, sf).select("k", "frame_id", F.round(2 + 6 * (n - 1) / F.greatest(F.lit(1), c - 1), 4).alias("radius"))


@query("sup68_template_corners", "SELECT c_custkey, (c_custkey % 100) * 3.0::DOUBLE AS x, (c_custkey % 50) * 1.5::DOUBLE AS y FROM customer")
def sup68(spark, sf):
    x, y = g.rescaled((F.col("c_custkey") % 100).cast("double"), (F.col("c_custkey") % 50).cast("double"), (640, 480), (1920, 720))
    return views.table(spark, sf, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


# ---- aggregates

@query("agg02_tactics", "WITH RECURSIVE " + MERGED + ", " + views.PLAYER[len(views.TRACK):].lstrip(", \n") + """, g AS (SELECT rally_id, player_id, count(DISTINCT player_id) OVER (PARTITION BY rally_id) AS roles, count(*) AS rows FROM player GROUP BY rally_id, player_id),
e AS (SELECT lpad(CAST(k AS VARCHAR), 3, '0') AS rally_id, count(*) AS n FROM merged GROUP BY 1)
SELECT g.rally_id, g.player_id, g.rows, CASE WHEN roles = 2 THEN 'experimental' ELSE 'not_eligible' END AS event_eligibility, CASE WHEN roles = 2 THEN coalesce(e.n, 0) END AS reversal_candidate_count FROM g LEFT JOIN e USING (rally_id)""")
def agg02(spark, sf):
    """Players by rally, what events may be told of them, and how many there are."""
    p = views.player(spark, sf)
    turns = events.merge_turns(events.reversals(views.track(spark, sf), K, 100.0), K, 3).groupBy(F.lpad(F.col("k").cast("string"), 3, "0").alias("rally_id")).agg(F.count("*").alias("n"))
    may = events.event_eligibility(p.select("rally_id", "player_id"), ["rally_id"], F.lit("auto")).select("rally_id", F.col("eligibility").alias("event_eligibility"))
    rows = p.groupBy("rally_id", "player_id").agg(F.count("*").alias("rows"))
    d = rows.join(may, "rally_id").join(turns, "rally_id", "left")
    return d.select("rally_id", "player_id", "rows", "event_eligibility", F.when(F.col("event_eligibility") != "not_eligible", F.coalesce("n", F.lit(0))).alias("reversal_candidate_count"))


@query("agg08_report", P + """ SELECT (SELECT count(DISTINCT rally_id) FROM player) AS usable_rallies, (SELECT count(*) FROM player WHERE player_id = 'near') AS near_rows, (SELECT count(*) FROM player WHERE player_id = 'far') AS far_rows, (SELECT count(*) FROM track WHERE event_type = 'purchase') AS candidate_events,
(SELECT count(*) FROM track WHERE event_type = 'purchase' AND confidence >= 0.5) AS classified_events, (SELECT count(*) FROM track WHERE visibility = 1) AS shuttle_valid, round((SELECT avg(visibility) FROM track), 6) AS visibility_ratio""")
def agg08(spark, sf):
    p = views.player(spark, sf)
    e = F.col("event_type") == "purchase"
    d = p.agg(F.countDistinct("rally_id").alias("usable_rallies"), *(F.count_if(F.col("player_id") == r_).alias(f"{r_}_rows") for r_ in ("near", "far")), F.count_if(e).alias("candidate_events"), F.count_if(e & (F.col("confidence") >= 0.5)).alias("classified_events"), F.count_if(F.col("visibility") == 1).alias("shuttle_valid"), F.avg("visibility").alias("visibility_ratio"))
    return d.withColumn("visibility_ratio", F.round("visibility_ratio", 6))


@query("agg24_legacy_counts", "SELECT coalesce(nullif(upper(c_mktsegment), ''), 'UNKNOWN') AS source, count(*) AS matches FROM customer GROUP BY 1")
def agg24(spark, sf):
    return views.table(spark, sf, "customer").groupBy(F.coalesce(F.nullif(F.upper("c_mktsegment"), F.lit("")), F.lit("UNKNOWN")).alias("source")).agg(F.count("*").alias("matches"))


@query("agg37_row_coverage", "SELECT vec_id, round(len(list_filter(range(17), lambda i: abs(embedding[3 * i + 3]) * 4 >= 0.35)) / 17 + 1e-10, 6) AS coverage FROM embeddings")
def agg37(spark, sf):
    from ..functions import pose
    from .queries_pose import _poses

    return _poses(spark, sf).select("vec_id", (F.size(pose.valid(F.col("k"), 0.35)) / 17).alias("coverage")).select("vec_id", _r("coverage"))


# ---- windows

@query("win08_smoothed_counts", T + ", s AS (SELECT k, frame_id, x, visibility = 1 AND confidence >= 0.2::DOUBLE AS ok FROM track) SELECT k, count(*) AS rows, count(*) FILTER (ok) AS source_valid_rows FROM s GROUP BY k")
def win08(spark, sf):
    valid = smoothing.row_is_valid(["x", "y"], 0.2)
    d = smoothing.smooth(views.track(spark, sf), K, ["x", "y"])
    return d.groupBy("k").agg(F.count("*").alias("rows"), F.count_if(valid).alias("source_valid_rows"))


@query("win21_neighbours", T + " SELECT k, frame_id, lag(frame_id) OVER w AS before, lead(frame_id) OVER w AS after FROM track WINDOW w AS (PARTITION BY k ORDER BY frame_id)")
def win21(spark, sf):
    w = smoothing.by_frame(K)
    return views.track(spark, sf).select("k", "frame_id", F.lag("frame_id").over(w).alias("before"), F.lead("frame_id").over(w).alias("after"))


@query("win23_event_numbers", T + " SELECT k, frame_id, 'R' || CAST(k AS VARCHAR) || printf('_E%03d', row_number() OVER (PARTITION BY k ORDER BY frame_id)) AS event_id FROM track WHERE event_type = 'signup'")
def win23(spark, sf):
    t = views.track(spark, sf).where("event_type = 'signup'").select("k", "frame_id", F.concat(F.lit("R"), F.col("k").cast("string")).alias("rally"))
    return events.numbered(t, K, "rally").select("k", "frame_id", "event_id")


@query("win34_recent_speed", P + """, o AS (SELECT k, frame_id, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n, court_x / 20 AS x, court_y / 20 AS y FROM player), w AS (SELECT k, frame_id, n, greatest(1, n - 6) AS w0 FROM o),
i AS (SELECT k, frame_id, n, unnest(list_distinct(list_concat(range(w0, n + 1, 5), [n]))) AS j FROM w), s AS (SELECT i.k, i.frame_id, j - lag(j) OVER q AS d, sqrt((o.x - lag(o.x) OVER q) ** 2 + (o.y - lag(o.y) OVER q) ** 2) AS m FROM i JOIN o ON o.k = i.k AND o.n = i.j WINDOW q AS (PARTITION BY i.k, i.frame_id ORDER BY j)),
v AS (SELECT k, frame_id, sum(m) AS m, sum(d) AS d FROM s WHERE m > 0.05 AND m < 8.0 / 12 * d GROUP BY ALL)
SELECT w.k, w.frame_id, round(CASE WHEN m IS NULL THEN 0 ELSE least(8, m / (d / 12.0::DOUBLE)) END + 1e-10, 5) AS current_speed FROM w LEFT JOIN v USING (k, frame_id)""")
def win34(spark, sf):
    p = views.player(spark, sf).select("k", "frame_id", (F.col("court_x") / 20).alias("x"), (F.col("court_y") / 20).alias("y"))
    return overlay.recent_speed(p, K, 12.0).select("k", "frame_id", _r("current_speed", 5))


# ---- events and their review

@query("elg03_phase_rejections", f"WITH {EV} SELECT k, event_id, NULL::VARCHAR AS phase, NULL::BIGINT AS start_frame, 'not_eligible' AS phase_eligibility, 'insufficient_contiguous_pose' AS phase_reject_reason, 'v1' AS phase_version FROM ev")
def elg03(spark, sf):
    return overlay.rejected_phases(_events(spark, sf), ["k", "event_id"], F.lit("insufficient_contiguous_pose"), "v1").drop("end_frame")


ENRICHED = f"""WITH {FOOT}, en AS (SELECT ev.k, ev.event_id, ev.c, count(t.frame_id) FILTER (t.visibility = 1) AS n FROM ev LEFT JOIN track t ON t.k = ev.k AND t.frame_id >= w0 AND t.frame_id < w1 GROUP BY ALL)
SELECT n.k, n.event_id, CASE WHEN n.c % 10 = 0 THEN 'invalid_event_window' WHEN n.n >= 5 THEN '' ELSE 'insufficient_kinematics_rows' END AS stability_reject_reason,
CASE WHEN n.c % 10 = 0 THEN 'invalid_event_window' WHEN n.c % 2 = 1 THEN 'far_player_analysis_disabled' ELSE b.reason END AS footwork_reject_reason FROM en n JOIN b USING (k, event_id)"""


@query("elg04_enriched_events", ENRICHED)
def elg04(spark, sf):
    e = _events(spark, sf).withColumn("player_id", F.when(F.col("candidate_frame") % 2 == 1, "far").otherwise("near"))
    t = views.track(spark, sf)
    kin = t.select("k", "frame_id", *(F.lit(0.1).alias(n) for n in ("support_width_ratio", "body_support_offset_ratio", "trunk_lean_deg", "left_knee_angle_deg", "right_knee_angle_deg")), F.when(F.col("visibility") == 1, "eligible").otherwise("not_eligible").alias("kinematics_eligibility"))
    p = views.player(spark, sf).where("visibility = 1").select("k", "frame_id", "timestamp", "court_x", "court_y")
    cut = e.withColumn("window_end_frame", F.when(F.col("candidate_frame") % 10 != 0, F.col("window_end_frame")))
    d = overlay.enrich(cut, descriptors.stability(e, kin, K), descriptors.footwork(e, p, K, home=2.0), K, far=False)
    return d.select("k", "event_id", "stability_reject_reason", "footwork_reject_reason")


@query("sup19_descriptor_summary", ENRICHED.replace("SELECT n.k, n.event_id,", ", d AS (SELECT n.k, n.event_id,", 1) + ") SELECT k, count(*) AS events, count(*) FILTER (stability_reject_reason = '') AS stability_eligible, count(*) FILTER (footwork_reject_reason = '') AS footwork_eligible FROM d GROUP BY k")
def sup19(spark, sf):
    d = elg04(spark, sf)
    return d.groupBy("k").agg(F.count("*").alias("events"), F.count_if(F.col("stability_reject_reason") == "").alias("stability_eligible"), F.count_if(F.col("footwork_reject_reason") == "").alias("footwork_eligible"))


@query("elg10_degraded_mode", T + " SELECT k, event_id, NULL::VARCHAR AS stroke_class, NULL::DOUBLE AS stroke_confidence, 'runtime_missing' AS model_reject_reason FROM track WHERE event_type = 'purchase'")
def elg10(spark, sf):
    return seams.without_model(views.track(spark, sf).where("event_type = 'purchase'").select("k", "event_id"), "stroke_class string, stroke_confidence double", "runtime_missing")


@query("elg09_model_runtime", T + " SELECT k, event_id, CASE WHEN x > y THEN 'smash' ELSE 'clear' END AS stroke_class, x / 100 AS stroke_confidence FROM track WHERE event_type = 'purchase'")
def elg09(spark, sf):
    """A stand-in for a model, loaded once a task and run by batches."""

    def load():
        def model(batch):
            return batch.assign(stroke_class=["smash" if a > b else "clear" for a, b in zip(batch["x"], batch["y"])], stroke_confidence=batch["x"] / 100)

        return model

    t = views.track(spark, sf).where("event_type = 'purchase'").select("k", "event_id", "x", "y")
    return seams.with_model(t, load, "stroke_class string, stroke_confidence double", ["x", "y"]).drop("x", "y")


@query("elg11_outcomes", T + " SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'low_confidence' ELSE 'not_classified' END AS outcome FROM track")
def elg11(spark, sf):
    n = F.col("event_id") % 4
    outcome = overlay.classification_outcome(F.when(n == 0, "eligible").otherwise("not_eligible"), F.when(n == 1, "low_confidence").when(n == 2, ""))
    return views.track(spark, sf).select("event_id", outcome.alias("outcome"))


@query("elg12_review_drafts", T + " SELECT 'v' || CAST(k AS VARCHAR) AS video_stem, '001' AS rally_id, event_id, frame_id AS candidate_frame, 'near' AS player_id, CASE WHEN event_id % 2 = 0 THEN 'eligible' ELSE 'too_far' END AS outcome, 'pending' AS review_status, 'd1' AS draft_version, '' AS true_frame, '' AS true_player_id, '' AS true_stroke_class, '' AS review_notes FROM track WHERE event_type = 'purchase'")
def elg12(spark, sf):
    e = views.track(spark, sf).where("event_type = 'purchase'").select(
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("video_stem"), F.lit("001").alias("rally_id"), "event_id", F.col("frame_id").alias("candidate_frame"), F.lit("near").alias("player_id"),
        F.when(F.col("event_id") % 2 == 0, "eligible").otherwise("no").alias("classification_eligibility"), F.when(F.col("event_id") % 2 != 0, "too_far").alias("classification_reject_reason"),
    )
    return overlay.review_draft(e, "d1")


# ---- sources

TIMELINE = '{"segments":[{"segment_id":"a","label":"MAIN_VIEW","start":0,"end":4},{"label":"main_view","start":9,"end":13},{"segment_id":"c","label":"REPLAY","start":20,"end":25},{"label":"MAIN_VIEW","start":30,"end":30}]}'


@query("src15_timeline", """SELECT * FROM (VALUES ('a', 0::BIGINT, 4::BIGINT), ('002', 9, 13)) AS t(segment_id, start, "end")""")
def src15(spark, sf):
    d = spark.createDataFrame([(TIMELINE,)], "j string").select(F.from_json("j", "segments array<struct<segment_id:string,label:string,start:bigint,end:bigint>>").alias("d")).select("d.*")
    return tables.main_view_intervals(d)


def _calibrations(spark):
    docs = ['{"video_stem":"v0","unit":"metre","corners":[[0,0],[1,0],[1,1],[0,1]],"homography":[[2,0,0],[0,2,0],[0,0,1]]}', '{"video_stem":"v1","unit":"pixel","corners":[[0,0],[1,0],[1,1],[0,1]],"homography":[[1,0,0],[0,1,0],[0,0,1]]}', '{"video_stem":"v2","unit":"metre","corners":[[0,0]],"homography":[[1,0,0],[0,1,0]]}']
    return spark.createDataFrame([(d,) for d in docs], "j string").select(F.from_json("j", tables.CALIBRATION).alias("c")).select("c.*")


@query("src12_homography_lookup", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS scale FROM customer")
def src12(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("v"), (F.col("c_custkey") % 4).cast("string")).alias("video_stem"))
    return tables.with_calibration(c, _calibrations(spark)).select("c_custkey", F.get(F.get("homography", F.lit(0)), F.lit(0)).alias("scale"))


@query("src13_calibration_lookup", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 1 END AS corners, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS rows FROM customer")
def src13(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("v"), (F.col("c_custkey") % 4).cast("string")).alias("video_stem"))
    return tables.with_calibration(c, _calibrations(spark)).select("c_custkey", F.when(F.col("corners").isNotNull(), F.size("corners")).alias("corners"), F.when(F.col("homography").isNotNull(), F.size("homography")).alias("rows"))


@query("src14_optional_corners", "SELECT c_custkey, c_custkey % 4 <> 3 AS has_corners FROM customer")
def src14(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("v"), (F.col("c_custkey") % 4).cast("string")).alias("video_stem"))
    return tables.with_calibration(c, _calibrations(spark)).select("c_custkey", F.col("corners").isNotNull().alias("has_corners"))


@query("src25_calibration_contract", "SELECT 'v0' AS video_stem")
def src25(spark, sf):
    return tables.valid_calibrations(_calibrations(spark)).select("video_stem")


@query("src07_video_list", "SELECT c_custkey, 'clips/' || CAST(c_custkey AS VARCHAR) || '.mp4' AS video_path FROM customer WHERE c_custkey % 5 <> 0")
def src07(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("clips/"), F.col("c_custkey").cast("string"), F.lit(".mp4"))).otherwise(" ").alias("output_path"))
    return tables.listed_videos(c).select("c_custkey", "video_path")


# ---- streams and runs

@query("str04_session_stats", T + ", s AS (SELECT k, frame_id, x, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY frame_id) AS session FROM track) SELECT k, session, count(*) AS rows, round(max(x), 4) AS top FROM s GROUP BY ALL")
def str04(spark, sf):
    t = smoothing.islands(views.track(spark, sf), K, F.col("event_type") == "error", "session")
    return t.groupBy("k", "session").agg(F.count("*").alias("rows"), F.round(F.max("x"), 4).alias("top"))


@query("str07_progress", T + " SELECT k, n AS done, c AS total FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n, count(*) OVER (PARTITION BY k) AS c FROM track) WHERE n % 10 = 0 OR n = c")
def str07(spark, sf):
    d = views.track(spark, sf).select("k", F.row_number().over(smoothing.by_frame(K)).alias("done"), F.count("*").over(Window.partitionBy("k")).alias("total"))
    return d.where("done % 10 = 0 or done = total")


@query("orc03_batch_isolation", T + " SELECT k, count(*) FILTER (event_type <> 'error') AS done, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (event_type = 'error') AS failed FROM track GROUP BY k")
def orc03(spark, sf):
    t = views.track(spark, sf)
    bad = F.when(F.col("event_type") == "error", F.col("event_id"))
    d = t.groupBy("k").agg(F.count_if(F.col("event_type") != "error").alias("done"), F.sort_array(F.collect_list(bad)).alias("f"))
    return d.select("k", "done", F.when(F.size("f") > 0, F.array_join(F.transform("f", lambda x: x.cast("string")), ",")).alias("failed"))
