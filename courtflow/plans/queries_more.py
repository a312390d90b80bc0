"""Further queries: descriptors, scores, joins of tables by frame, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scores
from ..operators import descriptors, events, metadata, movement, smoothing
from . import views
from .queries_play import BOXES, K, MERGED, SCORED, STEPS, SUMMARY, _boxes, _r, _scored, r
from .queries_tracks import FILLED, VALID

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- descriptors

EV = SCORED + ", ev AS (SELECT k, CAST(k AS VARCHAR) || '_' || CAST(frame_id AS VARCHAR) AS event_id, frame_id AS c, frame_id - 6 AS w0, frame_id + 9 AS w1 FROM candidates)"


def _events(spark, sf):
    return _scored(spark, sf).select("k", F.concat_ws("_", "k", "frame_id").alias("event_id"), F.col("frame_id").alias("candidate_frame"), (F.col("frame_id") - 6).alias("window_start_frame"), (F.col("frame_id") + 9).alias("window_end_frame"))


@query("agg11_stability_windows", f"""WITH {EV}, w AS (SELECT ev.k, ev.event_id, x / 100 AS s, y / 100 AS o, x - y AS t, x AS l, CASE WHEN frame_id % 2 = 0 THEN y END AS rk FROM ev JOIN track ON track.k = ev.k AND frame_id >= w0 AND frame_id < w1 AND visibility = 1),
ag AS (SELECT k, event_id, count(*) AS n, avg(s) AS s, sqrt(avg(o * o)) AS o, CASE WHEN count(t) >= 2 THEN stddev_pop(t) END AS t, avg(abs(l - rk)) AS d, CAST(max(s) >= 0.35 AS INT) AS wide FROM w GROUP BY ALL)
SELECT ev.k, ev.event_id, CASE WHEN coalesce(n, 0) >= 5 THEN 'eligible' ELSE 'not_eligible' END AS stability_eligibility, CASE WHEN coalesce(n, 0) >= 5 THEN '' ELSE 'insufficient_kinematics_rows' END AS stability_reject_reason, CASE WHEN n >= 5 THEN round(s + 1e-10, 6) END AS mean_support_width_ratio, CASE WHEN n >= 5 THEN round(o + 1e-10, 6) END AS body_support_offset_rms,
CASE WHEN n >= 5 THEN round(t + 1e-10, 6) END AS trunk_sway_std_deg, CASE WHEN n >= 5 THEN round(d + 1e-10, 6) END AS mean_knee_asymmetry_deg, CASE WHEN n >= 5 THEN wide END AS wide_support_candidate FROM ev LEFT JOIN ag USING (k, event_id)""")
def agg11(spark, sf):
    t = views.track(spark, sf)
    kin = t.select("k", "frame_id", (F.col("x") / 100).alias("support_width_ratio"), (F.col("y") / 100).alias("body_support_offset_ratio"), (F.col("x") - F.col("y")).alias("trunk_lean_deg"), F.col("x").alias("left_knee_angle_deg"),
                   F.when(F.col("frame_id") % 2 == 0, F.col("y")).alias("right_knee_angle_deg"), F.when(F.col("visibility") == 1, "eligible").otherwise("not_eligible").alias("kinematics_eligibility"))
    d = descriptors.stability(_events(spark, sf), kin, K)
    return d.select("k", "event_id", "stability_eligibility", "stability_reject_reason", *map(_r, ("mean_support_width_ratio", "body_support_offset_rms", "trunk_sway_std_deg", "mean_knee_asymmetry_deg")), "wide_support_candidate")


FOOT = f"""{EV}, w AS (SELECT ev.k, ev.event_id, c, frame_id AS f, timestamp AS t, y / 99 * 6.10::DOUBLE AS cx, x % 13.40::DOUBLE AS cy FROM ev JOIN track ON track.k = ev.k AND frame_id >= w0 AND frame_id < w1 AND visibility = 1),
l AS (SELECT *, sqrt((cx - lag(cx) OVER q) ** 2 + (cy - lag(cy) OVER q) ** 2) AS d, t - lag(t) OVER q AS dt, f - lag(f) OVER q AS df, first_value(cx) OVER q AS x0, first_value(cy) OVER q AS y0, min(f) FILTER (f >= c) OVER (PARTITION BY k, event_id) AS fa FROM w WINDOW q AS (PARTITION BY k, event_id ORDER BY f)),
fs AS (SELECT *, CASE WHEN dt > 0 AND df <= 2 THEN d / dt END AS v, f > fa AND sqrt((cx - x0) ** 2 + (cy - y0) ** 2) <= 2 AS back FROM l),
ag AS (SELECT k, event_id, count(*) AS n, count(*) FILTER (f <= c) AS nb, count(*) FILTER (f >= c) AS na, coalesce(sum(d) FILTER (f <= c), 0) AS pre, coalesce(sum(d) FILTER (f > fa), 0) AS post, sum(d) AS path, max(v) AS vmax, min(f) FILTER (v >= 0.5) AS ms, min(f) FILTER (f > c AND v < 0.5) AS br, min(f) FILTER (back) AS rf, min(t) FILTER (back) AS rt, arg_min(t, (abs(f - c), f)) AS ct FROM fs GROUP BY k, event_id),
b AS (SELECT ev.k, ev.event_id, ag.* EXCLUDE (k, event_id), CASE WHEN coalesce(n, 0) < 5 THEN 'insufficient_valid_court_positions' WHEN nb < 2 OR na < 2 THEN 'truncated_footwork_window' ELSE '' END AS reason FROM ev LEFT JOIN ag USING (k, event_id))"""


@query("agg12_footwork", f"""WITH {FOOT} SELECT k, event_id, CASE WHEN reason = '' THEN 'eligible' ELSE 'not_eligible' END AS footwork_eligibility, reason AS footwork_reject_reason, {', '.join(f"CASE WHEN reason = '' THEN round({a} + 1e-10, 6) END AS {n}" for a, n in (('pre', 'pre_contact_displacement_m'), ('post', 'post_contact_displacement_m'), ('path', 'event_path_distance_m'), ('vmax', 'max_footwork_speed_m_s'), ('(rt - ct)', 'recovery_time_s')))},
{', '.join(f"CASE WHEN reason = '' THEN {a} END AS {n}" for a, n in (('ms', 'movement_start_frame'), ('br', 'braking_frame'), ('rf', 'recovery_frame')))} FROM b""")
def agg12(spark, sf):
    p = views.player(spark, sf).where("visibility = 1").select("k", "frame_id", "timestamp", "court_x", "court_y")
    d = descriptors.footwork(_events(spark, sf), p, K, home=2.0)
    return d.select("k", "event_id", "footwork_eligibility", "footwork_reject_reason", *map(_r, ("pre_contact_displacement_m", "post_contact_displacement_m", "event_path_distance_m", "max_footwork_speed_m_s", "recovery_time_s")), "movement_start_frame", "braking_frame", "recovery_frame")


@query("agg14_cross_step", "WITH " + views.TRACK + """, s AS (SELECT k, frame_id, sign(x - y) AS s FROM track WHERE abs(x - y) > 1e-6 AND event_type = 'signup'), c AS (SELECT k, s <> lag(s) OVER (PARTITION BY k ORDER BY frame_id) AS c FROM s), a AS (SELECT k, CASE WHEN count(*) >= 3 THEN coalesce(bool_or(c), false) END AS crossed FROM c GROUP BY k)
SELECT k, crossed FROM (SELECT DISTINCT k FROM track WHERE event_type = 'signup') LEFT JOIN a USING (k)""")
def agg14(spark, sf):
    return descriptors.crossed_steps(views.track(spark, sf).where("event_type = 'signup'").withColumn("d", F.col("x") - F.col("y")), K, "d")


@query("win25_dominant_side", "WITH " + views.TRACK + f""", p AS (SELECT k, frame_id, timestamp, 0 AS i, 'left' AS side, x AS px, y AS py FROM track WHERE visibility = 1 UNION ALL SELECT k, frame_id, timestamp, 1, 'right', y * 3, x % 50 FROM track), l AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w <= 2 THEN sqrt((px - lag(px) OVER w) ** 2 + (py - lag(py) OVER w) ** 2) END AS d FROM p WINDOW w AS (PARTITION BY k, side ORDER BY frame_id)),
s AS (SELECT k, i, side, coalesce(sum(d), 0) AS path FROM l GROUP BY ALL) SELECT k, side, {r('path', digits=4)} FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY path DESC, i) = 1""")
def win25(spark, sf):
    seen = F.col("visibility") == 1
    t = views.track(spark, sf).withColumns({"lx": F.when(seen, F.col("x")), "ly": F.when(seen, F.col("y")), "rx": F.col("y") * 3, "ry": F.col("x") % 50})
    return descriptors.dominant_side(t, K, {"left": ("lx", "ly"), "right": ("rx", "ry")}).select("k", "side", _r("path", 4))


@query("agg09_reason_histogram", f"""WITH {FOOT}, rc AS (SELECT k, reason, count(*) AS n FROM b WHERE reason <> '' GROUP BY ALL), h AS (SELECT k, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS reasons FROM rc GROUP BY k), m AS (SELECT k, count(*) AS events, avg(CASE WHEN reason = '' THEN vmax END) AS max_footwork_speed_m_s FROM b GROUP BY k)
SELECT k, events, {r('max_footwork_speed_m_s')}, coalesce(reasons, '{{}}') AS reasons FROM m LEFT JOIN h USING (k)""")
def agg09(spark, sf):
    p = views.player(spark, sf).where("visibility = 1").select("k", "frame_id", "timestamp", "court_x", "court_y")
    d = descriptors.rally_summary(descriptors.footwork(_events(spark, sf), p, K, home=2.0), K, ["max_footwork_speed_m_s"], ["footwork_reject_reason"])
    return d.select("k", "events", _r("max_footwork_speed_m_s"), "reasons")


# ---- scores and anchors

PARTS = {"court": "x1 / 60", "geometry": "y1 / 12", "layout": "u1 / 40", "stability": "v1 / 17", "line": "x2 / 90", "reject": "y2 / 60"}


@query("geo30_view_score", BOXES + f""", p AS (SELECT l_orderkey, l_linenumber, {', '.join(f'least(1, {v}) AS p_{k}' for k, v in PARTS.items())} FROM b), s AS (SELECT *, least(1, greatest(0, 0.34::DOUBLE * p_court + 0.28::DOUBLE * p_geometry + 0.18::DOUBLE * p_layout + 0.12::DOUBLE * p_stability + 0.08::DOUBLE * p_line - 0.22::DOUBLE * p_reject)) AS score FROM p)
SELECT l_orderkey, l_linenumber, {r('score')}, CASE WHEN score >= 0.6 AND p_reject < 0.4 THEN '' WHEN p_reject >= 0.65 THEN 'likely_closeup_or_replay' WHEN p_geometry < 0.45 THEN 'low_court_geometry_score' WHEN p_court < 0.45 THEN 'low_court_score' WHEN p_layout < 0.35 THEN 'player_layout_invalid' ELSE 'low_main_view_score' END AS reason FROM s""")
def geo30(spark, sf):
    size = {"court": ("x1", 60), "geometry": ("y1", 12), "layout": ("u1", 40), "stability": ("v1", 17), "line": ("x2", 90), "reject": ("y2", 60)}
    parts = {k: F.least(F.lit(1.0), F.col(c) / n) for k, (c, n) in size.items()}
    b = _boxes(spark, sf).withColumn("score", scores.view_score(parts))
    return b.select("l_orderkey", "l_linenumber", _r("score"), scores.view_reason(parts, F.col("score"), 0.6).alias("reason"))


@query("geo22_box_anchors", BOXES + f" SELECT l_orderkey, l_linenumber, {r('(x1 + x2) / 2', 'ground_x')}, {r('y2', 'ground_y')}, {r('y1 + (y2 - y1) * 0.45::DOUBLE', 'body_y')}, CASE WHEN l_linenumber % 2 = 0 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM b")
def geo22(spark, sf):
    b = _boxes(spark, sf)
    a = scores.box_anchors(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(0.8), F.col("l_linenumber") % 2 == 0)
    return b.withColumn("a", a).select("l_orderkey", "l_linenumber", "a.*").select("l_orderkey", "l_linenumber", *map(_r, ("ground_x", "ground_y", "body_y")), "confidence")


@query("geo21_clamp_to_quad", BOXES + f""", q AS (SELECT l_orderkey, l_linenumber, u1 * 5 AS x, least(100, greatest(20, y2)) AS y FROM b), e AS (SELECT *, 60 - (y - 20) / 80 * 50 AS lo, 120 + (y - 20) / 80 * 60 AS hi FROM q) SELECT l_orderkey, l_linenumber, {r('least(hi, greatest(lo, x))', 'x')}, {r('y')} FROM e""")
def geo21(spark, sf):
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((60, 20), (120, 20), (180, 100), (10, 100))))
    x, y = scores.clamp_to_quad(F.col("u1") * 5, F.col("y2"), quad)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x"), _r("y"))


@query("geo12_polygon_area", BOXES + f" SELECT l_orderkey, l_linenumber, {r('abs((x1 * y2 - u1 * y1) + (u1 * v1 - x2 * y2) + (x2 * y1 - x1 * v1)) / 2', 'area', 4)} FROM b")
def geo12(spark, sf):
    s = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.shoelace(F.array(s("x1", "y1"), s("u1", "y2"), s("x2", "v1"))).alias("area")).select("l_orderkey", "l_linenumber", _r("area", 4))


@query("geo15_zones", f"WITH {views.PLAYER}, d AS (SELECT rally_id, frame_id, player_id, CASE WHEN player_id = 'near' THEN least(6.7, greatest(0, court_y - 6.7)) ELSE least(6.7, greatest(0, 6.7 - court_y)) END AS depth FROM player) SELECT rally_id, frame_id, player_id, {r('depth')}, CASE WHEN depth < 2.5 THEN 'front' WHEN depth > 4.5 THEN 'back' ELSE 'mid' END AS zone FROM d")
def geo15(spark, sf):
    p = views.player(spark, sf).withColumn("depth", g.own_depth(F.col("player_id"), F.col("court_y")))
    return p.select("rally_id", "frame_id", "player_id", _r("depth"), g.zone(F.col("depth")).alias("zone"))


@query("prj10_labels", """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'MAIN_VIEW' END AS label FROM events""")
def prj10(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "click", "MAIN_VIEW").when(kind == "view", "MAIN_LIVE_VIEW").when(kind == "signup", "MAIN_BIRDSEYE_LIVE").when(kind == "error", " main_view").otherwise("REPLAY")
    return views.table(spark, sf, "events").select("event_id", scores.label(raw).alias("label"))


@query("elg06_decision", """WITH e AS (SELECT event_id, value / 100 AS c, CASE event_id % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'far' ELSE 'unknown' END AS p, event_type <> 'error' AS ok FROM events) SELECT event_id, CASE WHEN NOT ok THEN 'not_eligible' WHEN p = 'unknown' THEN 'unknown' WHEN p <> 'near' THEN 'role_mismatch' WHEN c < 0.45 THEN 'low_confidence' ELSE 'accepted' END AS decision FROM e""")
def elg06(spark, sf):
    p = F.when(F.col("event_id") % 3 == 0, "near").when(F.col("event_id") % 3 == 1, "far").otherwise("unknown")
    return views.table(spark, sf, "events").select("event_id", scores.decision(F.col("event_type") != "error", p, F.lit("near"), F.col("value") / 100).alias("decision"))


@query("agg39_eta", f"WITH e AS (SELECT event_id, value AS s, (event_id % 101) / 100 AS d FROM events) SELECT event_id, CASE WHEN d >= 0.02 AND s >= 2 THEN round(s / d * (1 - d) + 1e-10, 6) END AS eta FROM e")
def agg39(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", scores.eta_seconds(F.col("value"), (F.col("event_id") % 101) / 100).alias("eta"))
    return e.select("event_id", _r("eta"))


# ---- joins by frame and reports


@query("joi02_frame_join", f"WITH {views.PLAYER} SELECT a.rally_id, a.frame_id, a.player_id AS first_player, b.event_type AS other, {r('sqrt((a.x - b.court_x) ** 2 + (a.y - b.court_y) ** 2)', 'distance')} FROM player a JOIN player b ON a.k = b.k AND a.frame_id = b.frame_id")
def joi02(spark, sf):
    p = views.player(spark, sf)
    b = p.select("k", "frame_id", F.col("court_x").alias("bx"), F.col("court_y").alias("by"), F.col("event_type").alias("other"))
    return p.join(b, ["k", "frame_id"]).withColumn("distance", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).select("rally_id", "frame_id", F.col("player_id").alias("first_player"), "other", _r("distance"))


@query("joi12_left_join_default", """SELECT o_orderkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), '000') AS rally_id, count(l_orderkey) AS rows FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY ALL""")
def joi12(spark, sf):
    li = views.table(spark, sf, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.select("o_orderkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), F.lit("000")).alias("rally_id"), F.coalesce("n", F.lit(0)).alias("rows"))


@query("joi16_anti_join", "WITH " + views.TRACK + " SELECT k, frame_id FROM track WHERE k NOT IN (SELECT k FROM track WHERE event_type = 'error' AND frame_id < 10)")
def joi16(spark, sf):
    t = views.track(spark, sf)
    return t.join(t.where("event_type = 'error' and frame_id < 10").select("k"), "k", "left_anti").select("k", "frame_id")


@query("prj22_tracked_roles", f"WITH {views.PLAYER} SELECT k, frame_id FROM track WHERE EXISTS (SELECT 1 FROM player p WHERE p.k = track.k AND p.player_id = 'near' AND p.frame_id BETWEEN 0 AND 20)")
def prj22(spark, sf):
    near = views.player(spark, sf).where("player_id = 'near' and frame_id between 0 and 20").select("k")
    return views.track(spark, sf).join(near, "k", "left_semi").select("k", "frame_id")


@query("prj27_register", "WITH o AS (SELECT c_custkey AS match_id, c_mktsegment AS tournament FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS match_id, 'new' AS tournament FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM o UNION ALL SELECT * FROM n WHERE match_id NOT IN (SELECT match_id FROM o)")
def prj27(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("match_id"), F.col("c_mktsegment").alias("tournament"))
    return metadata.register(c.where("match_id % 2 = 0"), c.where("match_id % 3 = 0").withColumn("tournament", F.lit("new")))


@query("agg17_track_stats", f"WITH {views.PLAYER} SELECT player_id, count(*) AS rows, count(DISTINCT rally_id) AS rallies, {r('avg(visibility)', 'visible_ratio')}, {r('avg(confidence)', 'mean_confidence')}, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM player GROUP BY player_id")
def agg17(spark, sf):
    d = views.player(spark, sf).groupBy("player_id").agg(F.count("*").alias("rows"), F.countDistinct("rally_id").alias("rallies"), F.avg("visibility").alias("visible_ratio"), F.avg("confidence").alias("mean_confidence"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))
    return d.select("player_id", "rows", "rallies", _r("visible_ratio"), _r("mean_confidence"), "first_frame", "last_frame")


@query("agg20_analysis_summary", f"WITH {SUMMARY} SELECT (SELECT count(*) FROM track) AS track_rows, (SELECT count(DISTINCT k) FROM track) AS tracks, (SELECT count(*) FROM summary) AS summaries, (SELECT count(*) FROM summary WHERE distance_steps > 0) AS eligible, (SELECT CAST(sum(rejected_position_rows) AS BIGINT) FROM rejected) AS rejected_rows")
def agg20(spark, sf):
    t, m = views.track(spark, sf), movement.movement_summary(views.player(spark, sf), with_hull=False)
    a = t.agg(F.count("*").alias("track_rows"), F.countDistinct("k").alias("tracks"))
    b = m.agg(F.count("*").alias("summaries"), F.sum((F.col("distance_steps") > 0).cast("int")).cast("bigint").alias("eligible"), F.sum("rejected_position_rows").alias("rejected_rows"))
    return a.join(F.broadcast(b))  # one row each


@query("agg28_smoothing_gain", f"WITH {FILLED} SELECT k, CAST(sum(CAST(v AS INT)) AS BIGINT) AS before, count(fx) AS after, count(fx) - CAST(sum(CAST(v AS INT)) AS BIGINT) AS gain FROM filled GROUP BY k")
def agg28(spark, sf):
    valid = smoothing.row_is_valid(["x", "y"], 0.2)
    d = smoothing.interpolate(views.track(spark, sf), K, ["x", "y"], valid).groupBy("k").agg(F.sum(valid.cast("int")).alias("before"), F.count("filled_x").alias("after"))
    return d.withColumn("gain", F.col("after") - F.col("before"))


@query("agg29_visible_ratio", f"WITH {views.TRACK} SELECT k, {r('avg(CAST(' + VALID + ' AS INT))', 'visible_ratio')}, rank() OVER (ORDER BY round(avg(CAST({VALID} AS INT)), 9) DESC, k) AS place FROM track GROUP BY k ORDER BY place LIMIT 20")
def agg29(spark, sf):
    d = views.track(spark, sf).groupBy("k").agg(F.avg(smoothing.row_is_valid(["x", "y"], 0.2).cast("int")).alias("visible_ratio"))
    top = d.withColumn("__o", F.round("visible_ratio", 9)).orderBy(F.desc("__o"), "k").limit(20)
    return top.select("k", _r("visible_ratio"), F.row_number().over(Window.orderBy(F.desc("__o"), "k")).cast("bigint").alias("place"))  # twenty rows


@query("agg36_mean_row", f"WITH a AS (SELECT event_type AS label, avg(value) AS v FROM events GROUP BY 1) SELECT label, {r('v')} FROM a UNION ALL SELECT 'MEAN', {r('avg(v)', 'v')} FROM a")
def agg36(spark, sf):
    a = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.avg("value").alias("v"))
    return a.unionByName(a.agg(F.lit("MEAN").alias("label"), F.avg("v").alias("v"))).select("label", _r("v"))


@query("win33_player_series", f"WITH {views.PLAYER} SELECT rally_id, player_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames, count(*) AS samples FROM player GROUP BY ALL")
def win33(spark, sf):
    d = views.player(spark, sf).groupBy("rally_id", "player_id").agg(F.array_sort(F.collect_list("frame_id")).alias("f"))
    return d.select("rally_id", "player_id", F.array_join(F.transform("f", lambda v: v.cast("string")), ",").alias("frames"), F.size("f").cast("bigint").alias("samples"))


@query("win28_speed_extremes", f"WITH {STEPS} SELECT rally_id, player_id, {r('max_by(speed, frame_id) FILTER (speed IS NOT NULL)', 'last_speed')}, {r('min_by(speed, frame_id) FILTER (speed IS NOT NULL)', 'first_speed')}, max_by(frame_id, (speed, -frame_id)) FILTER (speed IS NOT NULL) AS fastest_frame FROM steps GROUP BY ALL HAVING count(speed) > 0")
def win28(spark, sf):
    p, at = views.player(spark, sf).where(movement.on_own_half()), F.struct("frame_id", "court_x", "court_y")
    d = movement.steps(p, ["rally_id", "player_id"], "court_x", "court_y").where("speed is not null").groupBy("rally_id", "player_id")
    d = d.agg(F.max_by("speed", at).alias("last_speed"), F.min_by("speed", at).alias("first_speed"), F.max(F.struct("speed", (-F.col("frame_id")).alias("f"))).alias("m"))
    return d.select("rally_id", "player_id", _r("last_speed"), _r("first_speed"), (-F.col("m.f")).alias("fastest_frame"))


@query("sup57_running_distance", f"WITH {STEPS} SELECT rally_id, player_id, frame_id, {r('coalesce(sum(step) OVER w, 0)', 'distance')}, {r('coalesce(max(CASE WHEN speed IS NOT NULL THEN least(8, speed) END) OVER w, 0)', 'max_speed')} FROM (SELECT * FROM steps) WINDOW w AS (PARTITION BY rally_id, player_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)")
def sup57(spark, sf):
    keys = ["rally_id", "player_id"]
    d = movement.steps(views.player(spark, sf).where(movement.on_own_half()), keys, "court_x", "court_y")
    w = movement.in_order(keys, "court_x", "court_y").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"distance": F.coalesce(F.sum("step").over(w), F.lit(0.0)), "max_speed": F.coalesce(F.max(F.when(F.col("speed").isNotNull(), F.least(F.lit(8.0), F.col("speed")))).over(w), F.lit(0.0))})
    return d.select(*keys, "frame_id", _r("distance"), _r("max_speed"))


@query("sup27_best_and_worst", f"WITH a AS (SELECT user_id AS k, avg(value) AS v FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY round(v, 9), k) AS lo, row_number() OVER (ORDER BY round(v, 9) DESC, k) AS hi FROM a) SELECT k, {r('v')} FROM n WHERE lo <= 3 OR hi <= 3")
def sup27(spark, sf):
    a = views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.avg("value").alias("v")).withColumn("o", F.round("v", 9))
    return a.orderBy("o", "k").limit(3).unionByName(a.orderBy(F.desc("o"), "k").limit(3)).dropDuplicates(["k"]).select("k", _r("v"))


@query("str06_every_nth", "WITH " + views.TRACK + " SELECT k, frame_id, x FROM track WHERE frame_id % 5 = 0")
def str06(spark, sf):
    from ..streaming.sessions import every_nth

    return every_nth(views.track(spark, sf), 5).select("k", "frame_id", "x")


@query("evt1_reversal_events", f"WITH RECURSIVE {MERGED}, n AS (SELECT k, frame_id, angle, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n FROM merged) SELECT k, frame_id, lpad(CAST(k AS VARCHAR), 3, '0') || printf('_E%03d', n) AS event_id, 'reversal_candidate' AS event_type FROM n")
def evt1(spark, sf):
    e = events.merge_turns(events.reversals(views.track(spark, sf), K, 100.0), K, 3).withColumn("rally", F.lpad(F.col("k").cast("string"), 3, "0"))
    return events.numbered(e, K, "rally").select("k", "frame_id", "event_id", F.lit("reversal_candidate").alias("event_type"))


@query("src10_frame_count_rule", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - l_discount * 500) <= greatest(1, l_discount * 500 * 0.05) THEN l_quantity ELSE l_discount * 500 END AS frames FROM lineitem")
def src10(spark, sf):
    from ..sources.tables import trusted_frame_count

    d = views.table(spark, sf, "lineitem").withColumns({"a": F.col("l_quantity"), "b": F.col("l_discount") * 500})
    return d.select("l_orderkey", "l_linenumber", trusted_frame_count("a", "b").alias("frames"))
