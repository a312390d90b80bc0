"""Queries over what is left of projections, geometry, arrays, joins and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coerce, pose, scores
from ..functions import geometry as g
from ..operators import evaluation, movement, seams, segments, smoothing
from . import views
from .queries_more import EV, _events
from .queries_play import BOXES, K, STEPS, _boxes, _r, r
from .queries_pose import POSES, _poses, at
from .queries_tracks import DECIDED, win12

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- predicates and labels


@query("prj17_report_points", f"WITH {views.PLAYER} SELECT rally_id, player_id, frame_id, court_x, court_y FROM player WHERE court_x BETWEEN 0 AND 6.10 AND court_y BETWEEN 0 AND 13.40 AND CASE WHEN player_id = 'near' THEN court_y >= 6.7 ELSE court_y <= 6.7 END")
def prj17(spark, sf):
    return views.player(spark, sf).where(movement.on_own_half()).select("rally_id", "player_id", "frame_id", "court_x", "court_y")


@query("prj18_row_validity", "WITH " + views.TRACK + " SELECT k, frame_id, confidence >= 0.3 AND visibility <> 0 AS valid FROM track")
def prj18(spark, sf):
    return views.track(spark, sf).select("k", "frame_id", smoothing.row_is_valid(["x", "y"], 0.3).alias("valid"))


@query("prj21_match_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21)")
def prj21(spark, sf):
    wanted = [1, 2, 3, 5, 8, 13, 21]
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.where(F.col("o_orderkey").isin(wanted)) if wanted else o


@query("prj29_text_cleaning", """SELECT page_id, regexp_replace('[31m' || url || '[0m', '\\[[0-9;]*m', '', 'g') AS message, CASE WHEN lower(url) LIKE '%example.com%' THEN 'com' WHEN lower(url) LIKE '%example.net%' THEN 'net' ELSE 'default' END AS route FROM pages""")
def prj29(spark, sf):
    p = views.table(spark, sf, "pages")
    url = F.lower("url")
    route = F.when(F.contains(url, F.lit("example.com")), "com").when(F.contains(url, F.lit("example.net")), "net").otherwise("default")
    return p.select("page_id", F.regexp_replace(F.concat(F.lit("[31m"), "url", F.lit("[0m")), r"\[[0-9;]*m", "").alias("message"), route.alias("route"))


# ---- geometry

QUAD = [("x1", "y1"), ("x2", "v1"), ("q", "y2"), ("u1", "w")]


def _quads(spark, sf):
    b = _boxes(spark, sf).withColumns({"q": F.col("x2") + 5, "w": F.col("y2") + 3})
    return b, [(F.col(x), F.col(y)) for x, y in QUAD]


QUADS = BOXES + ", q AS (SELECT *, x2 + 5 AS q, y2 + 3 AS w FROM b)"


@query("geo27_geometry_score", QUADS + f""", s AS (SELECT *, abs((x1 * v1 - x2 * y1) + (x2 * y2 - q * v1) + (q * w - u1 * y2) + (u1 * y1 - x1 * w)) / 2 / 8000 AS area, x2 - x1 AS top, q - u1 AS bottom FROM q)
SELECT l_orderkey, l_linenumber, {r("0.5 * least(1, greatest(0, (area - 0.05) / 0.3)) + 0.3 * least(1, greatest(0, (bottom / 100 - 0.2) / 0.4)) + 0.2 * CASE WHEN top > 1e-6 AND bottom > 1e-6 THEN least(1, greatest(0, 1 - abs(ln(bottom / nullif(top, 0)) - 0.5))) ELSE 0 END", "score", 5)}, x1 < x2 AND u1 < q AND y1 + v1 < w + y2 AND x1 + u1 < x2 + q AS ordered FROM s WHERE top NOT BETWEEN -1e-3 AND 1e-3""")
def geo27(spark, sf):
    b, corners = _quads(spark, sf)
    d = b.where(F.abs(F.col("x2") - F.col("x1")) > 1e-3).withColumns({"score": scores.geometry_score(corners, 100, 80), "ordered": scores.ordered_corners(corners)})
    return d.select("l_orderkey", "l_linenumber", _r("score", 5), "ordered")


@query("geo39_expanded_roi", QUADS + f", m AS (SELECT *, least(x1, x2, q, u1) AS a, greatest(x1, x2, q, u1) AS c, least(y1, v1, y2, w) AS e, greatest(y1, v1, y2, w) AS f FROM q) SELECT l_orderkey, l_linenumber, {r('greatest(0, least(60, a - (c - a) * 0.08))', 'x1')}, {r('greatest(0, least(40, e - (f - e) * 0.08))', 'y1')}, {r('greatest(0, least(60, c + (c - a) * 0.08))', 'x2')}, {r('greatest(0, least(40, f + (f - e) * 0.08))', 'y2')} FROM m")
def geo39(spark, sf):
    b, corners = _quads(spark, sf)
    roi = scores.expanded_roi([c[0] for c in corners], [c[1] for c in corners], 60, 40)
    return b.select("l_orderkey", "l_linenumber", *(v.alias(n) for v, n in zip(roi, ("x1", "y1", "x2", "y2")))).select("l_orderkey", "l_linenumber", *map(_r, ("x1", "y1", "x2", "y2")))


@query("geo38_topdown_pixels", f"WITH {views.PLAYER}, p AS (SELECT rally_id, frame_id, court_x * 1.1 AS x, court_y * 1.1 AS y FROM player) SELECT rally_id, frame_id, CASE WHEN x <= 6.10 AND y <= 13.40 THEN CAST(round(x / 6.10::DOUBLE * 199) AS INT) END AS px, CASE WHEN x <= 6.10 AND y <= 13.40 THEN CAST(round(y / 13.40::DOUBLE * 439) AS INT) END AS py FROM p")
def geo38(spark, sf):
    p = views.player(spark, sf).withColumn("p", scores.topdown_pixel(F.col("court_x") * 1.1, F.col("court_y") * 1.1, 200, 440))
    return p.select("rally_id", "frame_id", F.col("p.px").alias("px"), F.col("p.py").alias("py"))


@query("geo24_body_height", BOXES + f", h AS (SELECT l_orderkey, l_linenumber, v1 AS body, y2 AS ground, y1 AS top, y2 AS bottom FROM b) SELECT l_orderkey, l_linenumber, {r('ground - body', 'px')}, {r('least(1, (ground - body) / (bottom - top))', 'ratio')} FROM h WHERE bottom - top > 1 AND ground - body >= 0")
def geo24(spark, sf):
    b = _boxes(spark, sf).withColumn("h", scores.body_height(F.col("v1"), F.col("y2"), F.col("y1"), F.col("y2"))).where("h is not null")
    return b.select("l_orderkey", "l_linenumber", "h.px", "h.ratio").select("l_orderkey", "l_linenumber", _r("px"), _r("ratio"))


@query("geo23_pose_anchors", POSES + f""", a AS (SELECT vec_id, g, {at('left_ankle')} AS l, {at('right_ankle')} AS q, list_filter(g, lambda p: p.name IN ('left_shoulder', 'right_shoulder', 'left_hip', 'right_hip')) AS t FROM good)
SELECT vec_id, CASE WHEN l IS NOT NULL AND q IS NOT NULL THEN 'ankles' WHEN l IS NOT NULL OR q IS NOT NULL THEN 'one_ankle' ELSE 'box' END AS source, {r('CASE WHEN l IS NOT NULL AND q IS NOT NULL THEN (l.x + q.x) / 2 WHEN l IS NOT NULL THEN l.x WHEN q IS NOT NULL THEN q.x ELSE 50 END', 'ground_x')},
{r('CASE WHEN len(t) >= 2 THEN list_avg(list_transform(t, lambda p: p.y)) ELSE 45 END', 'body_y')}, {r("CASE WHEN (l IS NULL) <> (q IS NULL) THEN 0.6 ELSE 0.8 END", 'confidence')} FROM a""")
def geo23(spark, sf):
    d = _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35))
    box = tuple(F.lit(float(v)) for v in (0, 0, 100, 100))
    d = d.withColumn("a", scores.pose_anchors(F.col("g"), box, F.lit(0.8))).select("vec_id", "a.*")
    return d.select("vec_id", "source", _r("ground_x"), _r("body_y"), _r("confidence"))


@query("arr08_pose_box", POSES + f" SELECT vec_id, {r('least(79, greatest(0, list_min(list_transform(g, lambda p: p.x)) - 5))', 'x1')}, {r('least(59, greatest(0, list_max(list_transform(g, lambda p: p.y)) + 5))', 'y2')} FROM good WHERE len(g) > 0")
def arr08(spark, sf):
    d = _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).withColumn("b", scores.pose_box(F.col("g"), 5.0, 80.0, 60.0)).where("b is not null")
    return d.select("vec_id", "b.x1", "b.y2").select("vec_id", _r("x1"), _r("y2"))


BONES = pose.EDGES


@query("arr10_bones", POSES + f", s AS (SELECT vec_id, {' + '.join(f'CASE WHEN {at(a)} IS NOT NULL AND {at(b)} IS NOT NULL THEN {at(b)}.x - {at(a)}.x ELSE 0 END' for a, b in BONES)} AS dx FROM good) SELECT vec_id, {len(BONES)} AS bones, {r('dx', digits=4)} FROM s")
def arr10(spark, sf):
    d = _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35))
    bone = lambda a, b: F.coalesce(pose.point(F.col("g"), b)["x"] - pose.point(F.col("g"), a)["x"], F.lit(0.0))
    d = d.withColumn("bones", F.array(*(bone(a, b) for a, b in BONES)))
    return d.select("vec_id", F.size("bones").alias("bones"), F.aggregate("bones", F.lit(0.0), lambda a, v: a + v).alias("dx")).select("vec_id", "bones", _r("dx", 4))


@query("arr11_same_length", "SELECT vec_id, CASE WHEN vec_id % 90 > 30 THEN 30 ELSE 30 END AS n, CAST(CASE WHEN vec_id % 90 + 1 <= 30 THEN (vec_id % 90 + 1) * (vec_id % 90) / 2 ELSE list_sum(list_filter(range(vec_id % 90 + 1), lambda x: x % CAST(ceil((vec_id % 90 + 1) / 30.0) AS BIGINT) = 0)) END AS BIGINT) AS total FROM embeddings")
def arr11(spark, sf):
    a = pose.same_length(F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 90), 30, F.lit(0).cast("bigint"))
    return views.table(spark, sf, "embeddings").select("vec_id", F.size(a).alias("n"), F.aggregate(a, F.lit(0).cast("bigint"), lambda x, v: x + v).alias("total"))


@query("arr12_top2_classes", "WITH l AS (SELECT vec_id, unnest(embedding[1:8]) AS v, unnest(range(8)) AS c FROM embeddings), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, c) <= 2) SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY v DESC, c) AS classes, bool_or(c = 3) AS holds_3 FROM k GROUP BY vec_id")
def arr12(spark, sf):
    pairs = F.transform(F.slice("embedding", 1, 8), lambda v, i: F.struct((-v).alias("v"), i.alias("c")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, 2), lambda p: p["c"])
    return views.table(spark, sf, "embeddings").select("vec_id", top.alias("t")).select("vec_id", F.array_join(F.transform("t", lambda c: c.cast("string")), ",").alias("classes"), F.array_contains("t", 3).alias("holds_3"))


# ---- joins

WIN = f"{EV}, w AS (SELECT ev.k, ev.event_id, c, track.frame_id, confidence, x, abs(track.frame_id - c) AS away FROM ev JOIN track ON track.k = ev.k AND track.frame_id >= w0 AND track.frame_id < w1)"


@query("joi04_interval_join", f"WITH {WIN} SELECT k, event_id, count(*) AS rows, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM w GROUP BY ALL")
def joi04(spark, sf):
    from ..operators.descriptors import window_rows

    d = window_rows(_events(spark, sf), views.track(spark, sf).select("k", "frame_id"), K)
    return d.groupBy("k", "event_id").agg(F.count("*").alias("rows"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query("joi11_nearest_snapshot", f"WITH {WIN} SELECT k, event_id, frame_id, x FROM w WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY k, event_id ORDER BY away, frame_id) = 1")
def joi11(spark, sf):
    from ..operators.descriptors import window_rows

    d = window_rows(_events(spark, sf), views.track(spark, sf).where("confidence >= 0.5").select("k", "frame_id", "x"), K)
    best = d.groupBy("k", "event_id").agg(F.min(F.struct(F.abs(F.col("frame_id") - F.col("candidate_frame")).alias("a"), "frame_id", "x")).alias("m"))
    return best.select("k", "event_id", "m.frame_id", "m.x")


@query("joi13_expected_frames", f"WITH {views.PLAYER}, e AS (SELECT k, count(*) AS expected FROM track WHERE visibility = 1 GROUP BY k), p AS (SELECT k, player_id, count(*) AS rows FROM player GROUP BY ALL) SELECT p.k, player_id, rows, coalesce(expected, 0) AS expected FROM p LEFT JOIN e USING (k)")
def joi13(spark, sf):
    p = views.player(spark, sf)
    e = p.where("visibility = 1").groupBy("k").agg(F.count("*").alias("expected"))
    return p.groupBy("k", "player_id").agg(F.count("*").alias("rows")).join(e, "k", "left").select("k", "player_id", "rows", F.coalesce("expected", F.lit(0)).alias("expected"))


@query("joi15_review_scope", f"WITH {EV} SELECT k, event_id FROM ev WHERE k IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 14)")
def joi15(spark, sf):
    scope = views.table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).count().where("count > 14")
    return _events(spark, sf).join(scope, "k", "left_semi").select("k", "event_id")


@query("joi23_montage_frames", f"WITH {EV} SELECT ev.k, ev.event_id, o AS place, t.frame_id FROM ev CROSS JOIN (VALUES (-2), (0), (2)) AS v(o) JOIN track t ON t.k = ev.k AND t.frame_id = c + o")
def joi23(spark, sf):
    e = _events(spark, sf).withColumn("place", F.explode(F.array(F.lit(-2), F.lit(0), F.lit(2)))).withColumn("frame_id", F.col("candidate_frame") + F.col("place"))
    return e.join(views.track(spark, sf).select("k", "frame_id"), ["k", "frame_id"]).select("k", "event_id", "place", "frame_id")


@query("joi24_first_existing", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 25")
def joi24(spark, sf):
    return views.table(spark, sf, "customer").join(views.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey").orderBy("c_custkey").limit(25)


# ---- aggregates and windows


@query("agg07_match_shuttle", f"WITH {STEPS} SELECT player_id, count(speed) AS samples, {r('avg(speed)', 'mean')}, {r('max(speed)', 'most')}, {r('median(speed)', 'median')} FROM steps GROUP BY player_id")
def agg07(spark, sf):
    d = movement.steps(views.player(spark, sf).where(movement.on_own_half()), ["rally_id", "player_id"], "court_x", "court_y").groupBy("player_id")
    return d.agg(F.count("speed").alias("samples"), F.avg("speed").alias("mean"), F.max("speed").alias("most"), F.percentile("speed", F.lit(0.5)).alias("median")).select("player_id", "samples", _r("mean"), _r("most"), _r("median"))


@query("agg13_path_length", "WITH " + views.TRACK + f", d AS (SELECT k, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM track WINDOW w AS (PARTITION BY k ORDER BY frame_id)) SELECT k, {r('coalesce(sum(d), 0)', 'path', 4)} FROM d GROUP BY k")
def agg13(spark, sf):
    w = smoothing.by_frame(K)
    d = views.track(spark, sf).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return d.groupBy("k").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("path")).select("k", _r("path", 4))


@query("agg19_quality_reasons", """WITH l AS (SELECT l_orderkey AS k, avg(CAST(l_discount > 0.05 AS INT)) AS o, avg(CAST(l_quantity > 47 AS INT)) AS a, avg(CAST(l_tax > 0.05 AS INT)) AS b FROM lineitem GROUP BY 1) SELECT k, CASE WHEN a > 0.05 THEN 'absurd_projection' WHEN o > 0.3 THEN 'too_many_outliers' WHEN b > 0.5 THEN 'boundary_pile_up' ELSE '' END AS reason FROM l""")
def agg19(spark, sf):
    share = lambda c: F.avg(F.expr(f"int({c})"))
    d = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(share("l_discount > 0.05").alias("o"), share("l_quantity > 47").alias("a"), share("l_tax > 0.05").alias("b"))
    return d.select("k", scores.quality_reason(F.col("o"), F.col("a"), F.col("b")).alias("reason"))


@query("agg26_readiness", f"WITH {EV}, j AS (SELECT ev.k, event_type FROM ev JOIN track USING (k) WHERE track.frame_id = c) SELECT event_type AS outcome, count(*) AS events, count(DISTINCT k) AS tracks FROM j GROUP BY 1")
def agg26(spark, sf):
    e = _events(spark, sf).select("k", F.col("candidate_frame").alias("frame_id")).join(views.track(spark, sf).select("k", "frame_id", "event_type"), ["k", "frame_id"])
    return e.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("events"), F.countDistinct("k").alias("tracks"))


@query("agg27_rows_by_rally", DECIDED.rstrip() + ", iv AS (SELECT k, start_frame, end_frame FROM r WHERE reason = 'active_play_evidence') SELECT iv.k, start_frame, count(*) AS rows, CAST(sum(visibility) AS BIGINT) AS visible FROM iv JOIN samples s ON s.k = iv.k AND s.frame_id >= start_frame AND s.frame_id < end_frame GROUP BY ALL")
def agg27(spark, sf):
    iv = win12(spark, sf).where("status = 'accepted'").select("k", "start_frame", "end_frame")
    return segments.within_intervals(views.samples(spark, sf), iv, K).groupBy("k", "start_frame").agg(F.count("*").alias("rows"), F.sum("visibility").alias("visible"))


@query("agg32_density_by_half", f"WITH {views.PLAYER}, b AS (SELECT player_id, CAST(least(floor(court_x / 6.10::DOUBLE * 10), 9) AS BIGINT) AS \"column\", count(*) AS points FROM player GROUP BY ALL) SELECT \"column\", coalesce(max(points) FILTER (player_id = 'near'), 0) AS near, coalesce(max(points) FILTER (player_id = 'far'), 0) AS far FROM b GROUP BY 1")
def agg32(spark, sf):
    d = movement.density(views.player(spark, sf), ["player_id"], F.col("court_x"), F.col("court_y"), 6.10, 13.40, 10, 1)
    return d.groupBy("column").pivot("player_id", ["near", "far"]).agg(F.max("points")).na.fill(0)


@query("agg33_kernel_density", f"""WITH {views.PLAYER}, c AS (SELECT CAST(least(floor(court_x / 6.10::DOUBLE * 12), 11) AS BIGINT) AS i, CAST(least(floor(court_y / 13.40::DOUBLE * 24), 23) AS BIGINT) AS j, count(*) AS n FROM player WHERE court_x BETWEEN 0 AND 6.10 AND court_y BETWEEN 0 AND 13.40 GROUP BY ALL), o AS (SELECT unnest(range(-3, 4)) AS d)
SELECT i + a.d AS i, j + b.d AS j, {r('sum(n * exp(-(a.d * a.d + b.d * b.d) / 2.0::DOUBLE))', 'density', 5)} FROM c, o a, o b WHERE i + a.d BETWEEN 0 AND 11 AND j + b.d BETWEEN 0 AND 23 GROUP BY ALL""")
def agg33(spark, sf):
    """A Gaussian kernel over cells, cut at three cells: each of the grid's few occupied cells spreads to its neighbours."""
    cells = movement.density(views.player(spark, sf), [], F.col("court_x"), F.col("court_y"), 6.10, 13.40, 12, 24)
    steps = F.sequence(F.lit(-3), F.lit(3))
    d = cells.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    d = d.select((F.col("column") + F.col("a")).alias("i"), (F.col("row") + F.col("b")).alias("j"), (F.col("points") * F.exp(-(F.col("a") ** 2 + F.col("b") ** 2) / 2)).alias("v")).where("i between 0 and 11 and j between 0 and 23")
    return d.groupBy("i", "j").agg(F.sum("v").alias("density")).select("i", "j", _r("density", 5))


@query("agg40_run_state", "SELECT user_id AS k, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def agg40(spark, sf):
    return views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.max_by("event_type", "event_id").alias("state"))


@query("win20_wrist_speed", "WITH " + views.TRACK + f", n AS (SELECT k, frame_id, lag(frame_id) OVER w AS pf, lead(frame_id) OVER w AS nf, sqrt((lead(x) OVER w - lag(x) OVER w) ** 2 + (lead(y) OVER w - lag(y) OVER w) ** 2) / nullif(lead(timestamp) OVER w - lag(timestamp) OVER w, 0) AS v FROM track WINDOW w AS (PARTITION BY k ORDER BY frame_id)) SELECT k, frame_id, CASE WHEN frame_id - pf <= 2 AND nf - frame_id <= 2 THEN round(v + 1e-10, 6) END AS speed FROM n")
def win20(spark, sf):
    w = smoothing.by_frame(K)
    p, n = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    v = F.try_divide(F.hypot(n("x") - p("x"), n("y") - p("y")), n("timestamp") - p("timestamp"))
    near = (F.col("frame_id") - p("frame_id") <= 2) & (n("frame_id") - F.col("frame_id") <= 2)
    return views.track(spark, sf).withColumn("speed", F.when(near, v)).select("k", "frame_id", _r("speed"))


@query("win32_interpolate_at", "WITH " + views.TRACK + f", a AS (SELECT k, min(frame_id) AS f0, max(frame_id) AS f1 FROM track GROUP BY k), t AS (SELECT k, f0, f1, unnest([-5, 10, 33, 500]) AS target FROM a), p AS (SELECT t.*, (SELECT max(frame_id) FROM track s WHERE s.k = t.k AND s.frame_id <= target) AS lo, (SELECT min(frame_id) FROM track s WHERE s.k = t.k AND s.frame_id >= target) AS hi FROM t) SELECT p.k, target, {r('CASE WHEN lo IS NULL THEN b.x WHEN hi IS NULL OR lo = hi THEN a.x ELSE a.x + (b.x - a.x) * ((target - lo) / (hi - lo)::DOUBLE) END', 'x')} FROM p LEFT JOIN track a ON a.k = p.k AND a.frame_id = lo LEFT JOIN track b ON b.k = p.k AND b.frame_id = hi")
def win32(spark, sf):
    t = views.track(spark, sf).select("k", F.col("frame_id").alias("f"), "x", F.lit(None).cast("bigint").alias("target"))
    targets = t.select("k").distinct().select("k", F.explode(F.array(*(F.lit(v).cast("bigint") for v in (-5, 10, 33, 500)))).alias("target"))
    both = t.unionByName(targets.select("k", F.col("target").alias("f"), F.lit(None).cast("double").alias("x"), "target"))
    w = Window.partitionBy("k").orderBy("f")
    s = F.when(F.col("x").isNotNull(), F.struct("f", "x"))
    # a range frame takes in the sample at the target itself, whichever of the two rows comes first
    d = both.withColumns({"a": F.last(s, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "b": F.first(s, True).over(w.rangeBetween(0, Window.unboundedFollowing))}).where("target is not null")
    a, b = F.col("a"), F.col("b")
    x = F.when(a.isNull(), b["x"]).when(b.isNull() | (a["f"] == b["f"]), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * ((F.col("target") - a["f"]) / (b["f"] - a["f"]).cast("double")))
    return d.withColumn("x", x).select("k", "target", _r("x"))


CHANGED = "WITH RECURSIVE " + views.TRACK + """, o AS (SELECT k, frame_id, (1::BIGINT << CAST(floor(x / 11) AS INT)) - 1 AS m, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n FROM track),
r AS (SELECT *, m AS c, (m & a) | (m & b) | (a & b) AS vote, bit_count(xor((m & a) | (m & b) | (a & b), m)) = 0 AND bit_count(xor((m & a) | (m & b) | (a & b), a)) = 0 AND bit_count(xor((m & a) | (m & b) | (a & b), b)) = 0 AND frame_id - f2 <= 12 AS steady
  FROM (SELECT *, lag(m) OVER w AS b, lag(m, 2) OVER w AS a, lag(frame_id) OVER w AS f1, lag(frame_id, 2) OVER w AS f2 FROM o WINDOW w AS (PARTITION BY k ORDER BY n))),
fold AS (
  SELECT k, 0::BIGINT AS n, NULL::BIGINT AS ref, 0::BIGINT AS since, NULL::BIGINT AS frame_id, NULL::DOUBLE AS change FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT k, n, CASE WHEN ok AND (ref IS NULL OR d > 0.014) THEN vote ELSE ref END, CASE WHEN ok AND ref IS NOT NULL AND d > 0.014 THEN n ELSE since END, CASE WHEN ok AND d > 0.014 AND d < 0.05 THEN f1 END, CASE WHEN ok AND d > 0.014 AND d < 0.05 THEN d END
  FROM (SELECT r.k, r.n, f.ref, f.since, r.vote, r.f1, r.n - f.since >= 3 AND r.steady AS ok, bit_count(xor(r.vote, f.ref)) / 64.0::DOUBLE AS d FROM fold f JOIN r ON r.k = f.k AND r.n = f.n + 1)
)"""


@query("win16_persistent_changes", CHANGED + " SELECT k, frame_id, change FROM fold WHERE change IS NOT NULL")
def win16(spark, sf):
    """Fingerprints of 64 bits, as many of them set as the value has elevens."""
    level = F.floor(F.col("x") / 11)
    t = views.track(spark, sf).select("k", "frame_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i < level, 1).otherwise(0)).alias("bits"))
    return seams.persistent_changes(t, "k", "bits", 6.0)


@query("elg05_input_eligibility", f"WITH {WIN}, ea AS (SELECT k, event_id, count(*) FILTER (confidence >= 0.5) / count(*) AS p, count(*) FILTER (x > 20) / count(*) AS s FROM w GROUP BY ALL) SELECT k, event_id, CASE WHEN p < 0.4 THEN 'insufficient_pose' WHEN s < 0.15 THEN 'insufficient_shuttle' ELSE '' END AS reason FROM ea")
def elg05(spark, sf):
    from ..operators.descriptors import window_rows

    d = window_rows(_events(spark, sf), views.track(spark, sf).select("k", "frame_id", "confidence", "x"), K)
    a = d.groupBy("k", "event_id").agg((F.count_if(F.col("confidence") >= 0.5) / F.count("*")).alias("p"), (F.count_if(F.col("x") > 20) / F.count("*")).alias("s"))
    return a.select("k", "event_id", F.when(F.col("p") < 0.4, "insufficient_pose").when(F.col("s") < 0.15, "insufficient_shuttle").otherwise("").alias("reason"))


@query("elg07_label_decode", "SELECT event_id, split_part(event_type || '_' || CASE WHEN value > 50 THEN 'smash' ELSE 'clear' END, '_', 1) AS role, CASE WHEN value > 50 THEN 'Smash' ELSE 'Clear' END AS name FROM events")
def elg07(spark, sf):
    coded = F.concat_ws("_", "event_type", F.when(F.col("value") > 50, "smash").otherwise("clear"))
    parts = F.split(coded, "_")
    return views.table(spark, sf, "events").select("event_id", parts[0].alias("role"), F.initcap(parts[1]).alias("name"))


@query("cal14_best_preview", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_extendedprice DESC, l_linenumber) = 1")
def cal14(spark, sf):
    best = views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_discount", "l_extendedprice", (-F.col("l_linenumber")).alias("n"))).alias("m"))
    return best.select("l_orderkey", (-F.col("m.n")).alias("l_linenumber"), "m.l_extendedprice")


@query("str03_bounded_history", "WITH " + views.TRACK + f" SELECT k, frame_id, {r('avg(x) OVER (PARTITION BY k ORDER BY frame_id ROWS 29 PRECEDING)', 'recent')}, count(*) OVER (PARTITION BY k ORDER BY frame_id ROWS 29 PRECEDING) AS n FROM track")
def str03(spark, sf):
    w = smoothing.by_frame(K).rowsBetween(-29, 0)
    return views.track(spark, sf).withColumns({"recent": F.avg("x").over(w), "n": F.count("*").over(w)}).select("k", "frame_id", _r("recent"), "n")


@query("str08_missing_timeout", "WITH " + views.TRACK + ", g AS (SELECT k, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY k ORDER BY frame_id) - 1 AS missed FROM track) SELECT k, frame_id, missed FROM g WHERE missed >= 5")
def str08(spark, sf):
    missed = F.col("frame_id") - F.lag("frame_id").over(smoothing.by_frame(K)) - 1
    return views.track(spark, sf).select("k", "frame_id", missed.alias("missed")).where("missed >= 5")


@query("sup58_zero_is_null", "SELECT event_id, nullif(value - value % 7, 0) AS v FROM events WHERE event_id % 3 = 0")
def sup58(spark, sf):
    v = F.col("value") - F.col("value") % 7
    return views.table(spark, sf, "events").where("event_id % 3 = 0").select("event_id", F.when(v != 0, v).alias("v"))


@query("sup69_retention", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 5")
def sup69(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return views.table(spark, sf, "orders").select("o_custkey", "o_orderkey", n.alias("n")).where("n > 5").drop("n")


@query("agg21_tolerant_sum", "SELECT user_id AS k, CAST(coalesce(sum(try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id % 10 AS VARCHAR) END AS BIGINT)), 0) AS BIGINT) AS total FROM events GROUP BY 1")
def agg21(spark, sf):
    cell = F.when(F.col("event_id") % 4 == 0, "x").otherwise((F.col("event_id") % 10).cast("string"))
    return views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.coalesce(F.sum(coerce.integer(cell)), F.lit(0)).alias("total"))


@query("agg25_recall_by_kind", "WITH t AS (SELECT user_id AS k, event_id AS id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 1800.0) AS BIGINT) AS f, event_type FROM events) SELECT q.k, count(DISTINCT q.id) AS hit FROM t q JOIN t p ON p.k = q.k AND p.event_type = 'click' AND q.event_type = 'view' AND abs(p.f - q.f) <= 24 GROUP BY 1")
def agg25_recall(spark, sf):
    from .queries_pose import _events as by_kind

    pairs = evaluation.tolerance_pairs(by_kind(spark, sf, "click"), by_kind(spark, sf, "view"), ["k"], 24)
    return pairs.groupBy("k").agg(F.countDistinct("ref_id").alias("hit"))


@query("geo03_inverse_map", BOXES + f" SELECT l_orderkey, l_linenumber, {r('x1', 'x', 4)}, {r('y1', 'y', 4)} FROM b")
def geo03(spark, sf):
    h = g.perspective([(0, 0), (40, 0), (46, 30), (-4, 31)], [(0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)])
    u, v = g.project(h, F.col("x1"), F.col("y1"))
    b = _boxes(spark, sf).withColumns({"u": u, "v": v})
    x, y = g.project(g.inverse(h), F.col("u"), F.col("v"))
    return b.withColumns({"x": x, "y": y}).select("l_orderkey", "l_linenumber", F.round(F.col("x") + 1e-10, 4).alias("x"), F.round(F.col("y") + 1e-10, 4).alias("y"))
