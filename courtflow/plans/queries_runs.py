"""Own entries of whole-table steps: smoothing, decisions, kinematics, phases, evaluation, manifests, and the shuttle tracker of a live session."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import coerce, scores
from ..operators import evaluation, movement, overlay, segments, smoothing, tracking
from . import views
from .queries_play import PHASES, SCORED, K, _r, _scored, r, win27
from .queries_pose import elg02
from .queries_pose import ORACLE_SQL as POSE_SQL
from .queries_pose import agg25
from .queries_tracking import DETECTIONS, _boxes
from .queries_tracks import DECIDED, FILLED, IV2, SMOOTHED, win12

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


@query("win07_smoothed_columns", f"WITH RECURSIVE {SMOOTHED} SELECT t.k, t.frame_id, round(sx + 1e-10, 6) AS sx, round(sy + 1e-10, 6) AS sy, CASE WHEN sx IS NOT NULL THEN 1 ELSE 0 END AS is_smoothed_valid FROM track t LEFT JOIN folded USING (k, frame_id)")
def win07(spark, sf):
    d = smoothing.smooth(views.track(spark, sf), K, ["x", "y"])
    return d.select("k", "frame_id", F.round(F.col("smoothed_x") + 1e-10, 6).alias("sx"), F.round(F.col("smoothed_y") + 1e-10, 6).alias("sy"), "is_smoothed_valid")


@query("sup25_smoothing_gain", f"WITH {FILLED} SELECT k % 5 AS video, k, count(fx) - CAST(sum(CAST(v AS INT)) AS BIGINT) AS gain FROM filled GROUP BY k")
def sup25(spark, sf):
    valid = smoothing.row_is_valid(["x", "y"], 0.2)
    d = smoothing.smoothing_summary(smoothing.smooth(views.track(spark, sf), K, ["x", "y"]), K, valid)
    return d.select((F.col("k") % 5).alias("video"), "k", (F.col("smoothed_valid_rows") - F.col("source_valid_rows")).alias("gain"))


@query("win11_rejected_rows", "WITH " + views.SAMPLES + """, s AS (SELECT *, CASE WHEN is_main_view THEN 1 ELSE 0 END AS b FROM samples), i AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY frame_id) AS i FROM s)
SELECT k, printf('R%03d', row_number() OVER (PARTITION BY k ORDER BY min(frame_id))) AS segment_id, min(frame_id) AS start_frame, max(frame_id) + 2 AS end_frame FROM i WHERE NOT is_main_view GROUP BY k, i""")
def win11(spark, sf):
    return segments.rejected_runs(views.samples(spark, sf), K, ~F.col("is_main_view"), 2, "reject_reason", "main_view_score").select("k", "segment_id", "start_frame", "end_frame")


@query("win13_decision_times", DECIDED + "SELECT k, printf('C%03d', row_number() OVER (PARTITION BY k ORDER BY start_frame)) AS candidate_id, round(start_frame / 25.0::DOUBLE, 3) AS start_time, round(end_frame / 25.0::DOUBLE, 3) AS end_time, round((end_frame - start_frame) / 25.0::DOUBLE, 3) AS duration_seconds FROM r")
def win13(spark, sf):
    return segments.with_times(win12(spark, sf), 25.0).select("k", "candidate_id", "start_time", "end_time", "duration_seconds")


@query("sup29_live_rallies", DECIDED.rstrip() + f", {IV2}" + """, c AS (SELECT s.k, s.frame_id, iv.start_frame, iv.end_frame FROM samples s JOIN iv ON iv.k = s.k AND iv.start_frame <= s.frame_id AND iv.end_frame <= s.frame_id + 4 AND s.frame_id - iv.end_frame <= 12 WHERE event_type = 'signup'
QUALIFY row_number() OVER (PARTITION BY s.k, s.frame_id ORDER BY iv.end_frame DESC, iv.start_frame DESC) = 1) SELECT k, start_frame, end_frame FROM c QUALIFY NOT coalesce(lag(start_frame) OVER (PARTITION BY k ORDER BY frame_id) = start_frame AND lag(end_frame) OVER (PARTITION BY k ORDER BY frame_id) = end_frame, false)""")
def sup29(spark, sf):
    iv = win12(spark, sf).where("status = 'accepted'").select("k", "start_frame", "end_frame")
    return segments.latest_before(views.samples(spark, sf).where("event_type = 'signup'").select("k", "frame_id"), iv, K, 4, 12).select("k", "start_frame", "end_frame")


@query("sup16_kinematics_table", POSE_SQL["elg02_kinematics"])
def sup16(spark, sf):
    return elg02(spark, sf)


@query("sup17_event_table", f"WITH {SCORED} SELECT k, frame_id AS candidate_frame, score AS candidate_score, frame_id - 6 AS window_start_frame, frame_id + 9 AS window_end_frame FROM candidates")
def sup17(spark, sf):
    return _scored(spark, sf).select("k", F.col("frame_id").alias("candidate_frame"), F.col("score").alias("candidate_score"), (F.col("frame_id") - 6).alias("window_start_frame"), (F.col("frame_id") + 9).alias("window_end_frame"))


@query("sup18_phase_table", f"WITH {PHASES}")
def sup18(spark, sf):
    return win27(spark, sf)


@query("sup20_evaluation", POSE_SQL["agg25_detection_metrics"])
def sup20(spark, sf):
    return agg25(spark, sf)


@query("agg35_rally_stats", P + f""", n AS (SELECT rally_id, player_id, frame_id, timestamp, court_x, court_y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY rally_id, player_id) AS n FROM player WHERE visibility = 1 WINDOW w AS (PARTITION BY rally_id, player_id ORDER BY frame_id)),
l AS (SELECT *, sqrt((court_x - lag(court_x) OVER w) ** 2 + (court_y - lag(court_y) OVER w) ** 2) AS d, timestamp - lag(timestamp) OVER w AS t FROM n WHERE i % 5 = 0 OR i = n - 1 WINDOW w AS (PARTITION BY rally_id, player_id ORDER BY frame_id))
SELECT rally_id, player_id, {r('coalesce(sum(d) FILTER (d > 0.05 AND d < 8 * t), 0)', 'distance_m')}, {r('max(timestamp) - min(timestamp)', 'elapsed')} FROM l GROUP BY ALL HAVING count(*) > 1""")
def agg35(spark, sf):
    """By rally and player, over the points that are there, each with its own time."""
    d = movement.strided_stats(views.player(spark, sf).where("visibility = 1"), ["rally_id", "player_id"], "court_x", "court_y").where("samples > 1")
    return d.select("rally_id", "player_id", _r("distance_m"), _r("elapsed"))


@query("sup64_match_totals", P + f""", n AS (SELECT player_id, rally_id, frame_id, court_x, court_y FROM player WHERE visibility = 1), l AS (SELECT player_id, rally_id, sqrt((court_x - lag(court_x) OVER w) ** 2 + (court_y - lag(court_y) OVER w) ** 2) AS d, frame_id - lag(frame_id) OVER w AS g FROM n WINDOW w AS (PARTITION BY player_id, rally_id ORDER BY frame_id))
SELECT player_id, count(DISTINCT rally_id) AS rallies, {r('coalesce(sum(d) FILTER (g = 1), 0)', 'distance_m', 4)} FROM l GROUP BY player_id""")
def sup64(spark, sf):
    """Rallies added up once each; the match's own total isn't one of them."""
    steps = movement.steps(views.player(spark, sf).where("visibility = 1"), ["player_id", "rally_id"], "court_x", "court_y", max_speed=None)
    d = steps.groupBy("player_id").agg(F.countDistinct("rally_id").alias("rallies"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance_m"))
    return d.select("player_id", "rallies", _r("distance_m", 4))


@query("sup36_manifest", "SELECT k, list_max([n]) AS stages, s AS last_success FROM (SELECT o_custkey % 20 AS k, 2 + o_custkey % 20 % 2 AS n, CASE WHEN o_custkey % 20 % 2 = 1 THEN 'rally' ELSE 'main_view' END AS s FROM orders GROUP BY 1) ")
def sup36(spark, sf):
    stage = lambda name, status: F.concat(F.lit('{"name":"' + name + '","status":"'), status, F.lit('"}'))
    odd = F.col("k") % 2 == 1
    o = views.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("k")).distinct()
    more = F.when(odd, F.concat(F.lit(","), stage("rally", F.lit("success")))).otherwise("")
    text = F.concat(F.lit('{"stages":['), stage("main_view", F.lit("success")), F.lit(","), stage("calibration", F.lit("failed")), more, F.lit("]}"))
    m = o.select("k", scores.manifest(text).alias("m"))
    return m.select("k", F.size("m").cast("bigint").alias("stages"), F.get(F.filter("m", lambda s: s["status"] == "success"), F.size(F.filter("m", lambda s: s["status"] == "success")) - 1)["name"].alias("last_success"))


@query("sup51_annotations", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'corners_wrong_order' ELSE 'invalid_text' END AS reasons FROM orders")
def sup51(spark, sf):
    n = F.col("o_orderkey") % 3
    text = F.when(n == 0, "0.2,0.1;0.8,0.1;0.9,0.9;0.1,0.9").when(n == 1, "0.8,0.1;0.9,0.9;0.1,0.9;0.2,0.1").otherwise("0.2;0.1")
    c = coerce.corner_text(text)
    corners = [(F.get(F.get(c, F.lit(i)), F.lit(0)) * 640, F.get(F.get(c, F.lit(i)), F.lit(1)) * 480) for i in range(4)]
    reasons = F.array_join(scores.calibration_reasons(corners, 640, 480, F.lit(1.0)), ",")
    return views.table(spark, sf, "orders").select("o_orderkey", F.when(c.isNull(), "invalid_text").otherwise(reasons).alias("reasons"))


@query("cal10_calibrated_videos", f"""WITH {DETECTIONS}, g AS (SELECT video, count(*) AS candidates, count(*) FILTER (score >= 0.5) AS accepted, max(score) AS best FROM d GROUP BY video) SELECT video, candidates, accepted, CASE WHEN accepted >= 2 THEN 'calibrated' WHEN accepted = 1 THEN 'unstable' ELSE 'rejected' END AS status FROM g""")
def cal10(spark, sf):
    return tracking.calibration_status(_boxes(spark, sf), ["video"], F.col("score") >= 0.5, 2)


@query("sup53_progress", T + " SELECT k, max(frame_id) AS last_frame, round(count(*) FILTER (visibility = 1) / count(*), 4) AS done, CASE WHEN count(*) FILTER (event_type = 'error') > 2 THEN 'failed' WHEN count(*) FILTER (visibility = 1) = count(*) THEN 'success' ELSE 'running' END AS state FROM track GROUP BY k")
def sup53(spark, sf):
    n = F.count("*")
    state = F.when(F.count_if(F.col("event_type") == "error") > 2, "failed").when(F.count_if(F.col("visibility") == 1) == n, "success").otherwise("running")
    return views.track(spark, sf).groupBy("k").agg(F.max("frame_id").alias("last_frame"), F.round(F.count_if(F.col("visibility") == 1) / n, 4).alias("done"), state.alias("state"))


@query("sup60_heading", T + " SELECT k, frame_id, coalesce(2 * lag(x) OVER w - lag(x, 2) OVER w, lag(x) OVER w) AS px, coalesce(2 * lag(y) OVER w - lag(y, 2) OVER w, lag(y) OVER w) AS py FROM track WHERE visibility = 1 WINDOW w AS (PARTITION BY k ORDER BY frame_id)")
def sup60(spark, sf):
    return tracking.headings(views.track(spark, sf).where("visibility = 1"), K).select("k", "frame_id", "px", "py")


@query("sup62_session_resets", T + ", s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY frame_id) AS session FROM track) SELECT k, frame_id, coalesce(2 * lag(x) OVER w - lag(x, 2) OVER w, lag(x) OVER w) AS px FROM s WINDOW w AS (PARTITION BY k, session ORDER BY frame_id)")
def sup62(spark, sf):
    t = smoothing.islands(views.track(spark, sf), K, F.col("event_type") == "error", "session")
    return tracking.headings(t, ["k", "session"]).select("k", "frame_id", "px")


@query("trk16_selection", f"WITH {DETECTIONS} SELECT video, frame_id, x1, y1 FROM d QUALIFY row_number() OVER (PARTITION BY video, frame_id ORDER BY round(score * 1000 - 1.4::DOUBLE * sqrt((x1 - 300) ** 2 + (y1 - 200) ** 2) - 4000 * ((x2 - x1) * 90 / 2073600), 6) DESC, x1, y1) = 1")
def trk16(spark, sf):
    d = _boxes(spark, sf)
    worth = tracking.shuttle_worth(F.col("score"), F.col("x1"), F.col("y1"), (F.lit(300.0), F.lit(200.0)), (F.col("x2") - F.col("x1")) * 90 / 2073600)
    return overlay.last_by(d.withColumn("w", F.round(worth, 6)), ["video", "frame_id"], ["w", (-F.col("x1")), (-F.col("y1"))]).select("video", "frame_id", "x1", "y1")


FOLLOWED = f"""WITH RECURSIVE {DETECTIONS}, c AS (SELECT video, frame_id, x1 AS x, y1 AS y, score, (x2 - x1) * 90 / 2073600 AS area, dense_rank() OVER (PARTITION BY video ORDER BY frame_id) AS n FROM d), fr AS (SELECT DISTINCT video, n, frame_id FROM c), fold AS (
  SELECT video, 0::BIGINT AS n, NULL::BIGINT AS frame_id, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS px, NULL::DOUBLE AS py, 0::BIGINT AS gone, false AS accepted FROM (SELECT DISTINCT video FROM c)
  UNION ALL SELECT video, n, frame_id, b.x, b.y, CASE WHEN ok THEN b.x ELSE lx END, CASE WHEN ok THEN b.y ELSE ly END, CASE WHEN ok THEN CASE WHEN lx IS NULL THEN b.x ELSE 2 * b.x - lx END ELSE px END, CASE WHEN ok THEN CASE WHEN ly IS NULL THEN b.y ELSE 2 * b.y - ly END ELSE py END, CASE WHEN ok THEN 0 ELSE gone + 1 END, ok
  FROM (SELECT *, b.x BETWEEN 20 - 46 AND 600 + 46 AND b.y BETWEEN 20 - 46 AND 380 + 46 AND (lx IS NULL OR gone > 5 OR sqrt((b.x - lx) ** 2 + (b.y - ly) ** 2) <= 220 AND sqrt((b.x - px) ** 2 + (b.y - py) ** 2) <= 260) AS ok FROM (
    SELECT f.video, fr.n, fr.frame_id, f.lx, f.ly, f.px, f.py, f.gone + CASE WHEN f.frame_id IS NULL THEN 0 ELSE fr.frame_id - f.frame_id - 1 END AS gone,
      (SELECT arg_max(struct_pack(x := c.x, y := c.y), (CASE WHEN f.lx IS NULL THEN c.score ELSE c.score * 1000 - 1.4::DOUBLE * sqrt((c.x - f.px) ** 2 + (c.y - f.py) ** 2) - 4000 * c.area END, c.score, -c.x, -c.y)) FROM c WHERE c.video = fr.video AND c.n = fr.n) AS b
    FROM fold f JOIN fr ON fr.video = f.video AND fr.n = f.n + 1))
)"""


@query("trk18_shuttle_tracker", FOLLOWED + " SELECT video, frame_id, x, y, accepted FROM fold WHERE n > 0")
def trk18(spark, sf):
    c = _boxes(spark, sf).select("video", "frame_id", F.col("x1").alias("x"), F.col("y1").alias("y"), "score", ((F.col("x2") - F.col("x1")) * 90 / 2073600).alias("area"))
    return tracking.track_shuttle(c, "video", (20.0, 20.0, 600.0, 380.0))


@query("elg08_class_contract", T + " SELECT k, event_id, event_type IN ('click', 'view') AS known FROM track")
def elg08(spark, sf):
    """Labels outside the declared ones are told apart, not guessed."""
    return views.track(spark, sf).select("k", "event_id", scores.declared(F.col("event_type"), ("click", "view")).alias("known"))


@query("orc07_resume_identity", T + " SELECT k, event_id, event_id % 4 = 0 AND event_id % 6 = 0 AS may_resume FROM track")
def orc07(spark, sf):
    e = F.col("event_id")
    same = scores.may_resume(F.when(e % 4 == 0, "c1").otherwise("c2"), F.lit("c1"), F.when(e % 6 == 0, "s1"), F.lit("s1"))
    return views.track(spark, sf).select("k", "event_id", same.alias("may_resume"))


@query("orc12_mode_profiles", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'clipped_overhead_gpu.yaml' WHEN 1 THEN 'clipped_low_angle_gpu.yaml' WHEN 2 THEN 'low_angle_gpu.yaml' END AS profile FROM orders")
def orc12(spark, sf):
    n = F.col("o_orderkey") % 4
    kind, view = F.when(n.isin(0, 1), "clipped").when(n == 2, "full").otherwise("live"), F.when(n == 0, "overhead").otherwise("low_angle")
    return views.table(spark, sf, "orders").select("o_orderkey", scores.mode_profile(kind, view).alias("profile"))
