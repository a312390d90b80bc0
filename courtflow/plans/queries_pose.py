"""Queries over poses, evaluation, metadata and streams of batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import pose
from ..operators import evaluation
from . import views
from .queries_play import _r, r

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _poses(spark, sf):
    """17 joints out of the first 51 numbers of a vector."""
    e = views.table(spark, sf, "embeddings")
    value = lambda i: F.element_at("embedding", i).cast("double")
    joints = F.array(*(F.struct(F.lit(n).alias("name"), (value(3 * i + 1) * 100).alias("x"), (value(3 * i + 2) * 100).alias("y"), F.least(F.lit(1.0), F.abs(value(3 * i + 3)) * 4).alias("confidence")) for i, n in enumerate(pose.NAMES)))
    return e.select("vec_id", "label", joints.alias("k"))


POSES = (
    "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), poses AS (SELECT vec_id, label, ["
    + ", ".join(f"{{'name': '{n}', 'x': v[{3 * i + 1}] * 100, 'y': v[{3 * i + 2}] * 100, 'confidence': least(1.0::DOUBLE, abs(v[{3 * i + 3}]) * 4)}}" for i, n in enumerate(pose.NAMES))
    + "] AS k FROM e), good AS (SELECT *, list_filter(k, lambda p: p.confidence >= 0.35) AS g FROM poses)"
)


def at(name: str) -> str:
    return f"list_filter(g, lambda p: p.name = '{name}')[1]"


@query("arr01_parse_keypoints", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 0 END AS n FROM embeddings")
def arr01(spark, sf):
    cells = [F.lit('[{"name":"a","x":1,"y":2.5,"confidence":0.9},{"name":"b","x":3,"y":4,"confidence":1}]'), F.lit('[{"name":"a","x":"?","y":2,"confidence":0.9},{"name":"b","x":3,"y":4,"confidence":1}]'), F.lit("{oops")]
    i = F.col("vec_id") % 3
    cell = F.when(i == 0, cells[0]).when(i == 1, cells[1]).otherwise(cells[2])
    return views.table(spark, sf, "embeddings").select("vec_id", F.size(pose.parse(cell)).alias("n"))


@query("arr02_json_round_trip", POSES + f" SELECT vec_id, 17 AS n, {r('list_sum(list_transform(k, lambda p: round(p.x, 3)))', 'x', 3)} FROM poses")
def arr02(spark, sf):
    d = _poses(spark, sf).withColumn("b", pose.parse(pose.to_json(F.col("k"))))
    return d.select("vec_id", F.size("b").alias("n"), F.aggregate(F.transform("b", lambda p: p["x"]), F.lit(0.0), lambda a, v: a + v).alias("x")).select("vec_id", "n", _r("x", 3))


@query("arr04_valid_keypoints", POSES + f" SELECT vec_id, len(g) AS n, {r('coalesce(list_avg(list_transform(g, lambda p: p.confidence)), 0)', 'mean_confidence')} FROM good")
def arr04(spark, sf):
    d = _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35))
    return d.select("vec_id", F.size("g").cast("bigint").alias("n"), pose.mean_confidence(F.col("g")).alias("mean_confidence")).select("vec_id", "n", _r("mean_confidence"))


#: Written out again, so that a wrong edge in the code can't hide.
SKELETON = """left_ear left_eye, left_eye nose, nose right_eye, right_eye right_ear, left_shoulder right_shoulder, left_shoulder left_elbow, left_elbow left_wrist, right_shoulder right_elbow,
right_elbow right_wrist, left_shoulder left_hip, right_shoulder right_hip, left_hip right_hip, left_hip left_knee, left_knee left_ankle, right_hip right_knee, right_knee right_ankle"""


@query("arr07_edges", POSES + " SELECT vec_id, CAST(" + " + ".join("CAST(" + " AND ".join(f"{at(n)} IS NOT NULL" for n in e.split()) + " AS INT)" for e in SKELETON.split(",")) + " AS BIGINT) AS edges FROM good")
def arr07(spark, sf):
    return _poses(spark, sf).select("vec_id", F.size(pose.edges(pose.valid(F.col("k"), 0.35))).cast("bigint").alias("edges"))


@query("geo09_torso_centre", POSES + f""", m AS (SELECT vec_id, ({at('left_shoulder')}.x + {at('right_shoulder')}.x) / 2 AS sx, ({at('left_shoulder')}.y + {at('right_shoulder')}.y) / 2 AS sy, ({at('left_hip')}.x + {at('right_hip')}.x) / 2 AS hx, ({at('left_hip')}.y + {at('right_hip')}.y) / 2 AS hy FROM good)
SELECT vec_id, {r('coalesce((sx + hx) / 2, sx, hx)', 'x')}, {r('coalesce((sy + hy) / 2, sy, hy)', 'y')} FROM m""")
def geo09(spark, sf):
    x, y = pose.torso_centre(F.col("g"))
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", x.alias("x"), y.alias("y")).select("vec_id", _r("x"), _r("y"))


JOINTS = {"left_elbow": ("left_shoulder", "left_elbow", "left_wrist"), "right_elbow": ("right_shoulder", "right_elbow", "right_wrist"), "left_knee": ("left_hip", "left_knee", "left_ankle"), "right_knee": ("right_hip", "right_knee", "right_ankle")}


def _angle_sql(a, b, c):
    ux, uy, vx, vy = f"({at(a)}.x - {at(b)}.x)", f"({at(a)}.y - {at(b)}.y)", f"({at(c)}.x - {at(b)}.x)", f"({at(c)}.y - {at(b)}.y)"
    cos = f"({ux} * {vx} + {uy} * {vy}) / nullif(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}), 0)"
    return f"CASE WHEN {cos} IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, {cos})))), 4) END"


@query("elg02_kinematics", POSES + ", a AS (SELECT vec_id, len(g) AS n, " + ", ".join(f"{_angle_sql(*v)} AS {k}" for k, v in JOINTS.items()) + """ FROM good)
SELECT vec_id, left_elbow, right_elbow, left_knee, right_knee, CASE WHEN vec_id % 10 = 0 THEN 'pose_not_valid' WHEN n = 0 THEN 'no_keypoints' WHEN n / 17.0 < 0.35 THEN 'insufficient_keypoint_coverage' WHEN coalesce(left_elbow, right_elbow, left_knee, right_knee) IS NULL THEN 'no_kinematic_metric' ELSE '' END AS reason FROM a""")
def elg02(spark, sf):
    d = _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35))
    for name, joints in JOINTS.items():
        a, b, c = ((pose.point(F.col("g"), j)["x"], pose.point(F.col("g"), j)["y"]) for j in joints)
        d = d.withColumn(name, F.round(g.vertex_angle(a, b, c), 4))
    n = F.size("g")
    reason = F.when(F.col("vec_id") % 10 == 0, "pose_not_valid").when(n == 0, "no_keypoints").when(n / 17 < 0.35, "insufficient_keypoint_coverage").when(F.coalesce(*JOINTS).isNull(), "no_kinematic_metric").otherwise("")
    return d.select("vec_id", *JOINTS, reason.alias("reason"))


# ---- evaluation

TRUTH = "WITH t AS (SELECT user_id AS k, event_id AS id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 1800.0) AS BIGINT) AS frame_id, event_type FROM events), p AS (SELECT * FROM t WHERE event_type = 'click'), q AS (SELECT * FROM t WHERE event_type = 'view')"


def _events(spark, sf, kind):
    frame = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1800).cast("bigint")
    return views.table(spark, sf, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), frame.alias("frame_id"))


@query("joi09_tolerance_pairs", TRUTH + " SELECT p.k, p.id AS pred_id, q.id AS ref_id, abs(p.frame_id - q.frame_id) AS error FROM p JOIN q ON p.k = q.k AND abs(p.frame_id - q.frame_id) <= 12")
def joi09(spark, sf):
    return evaluation.tolerance_pairs(_events(spark, sf, "click"), _events(spark, sf, "view"), ["k"], 12).select("k", "pred_id", "ref_id", "error")


MATCHED = TRUTH.replace("WITH t AS", "WITH RECURSIVE t AS") + """, pairs AS (SELECT p.k, p.id AS pred_id, p.frame_id AS pf, q.id AS ref_id, q.frame_id AS rf, abs(p.frame_id - q.frame_id) AS error FROM p JOIN q ON p.k = q.k AND abs(p.frame_id - q.frame_id) <= 12),
refs AS (SELECT k, ref_id, row_number() OVER (PARTITION BY k ORDER BY rf, ref_id) AS n FROM (SELECT DISTINCT k, ref_id, rf FROM pairs)), fold AS (
  SELECT k, 0::BIGINT AS n, NULL::BIGINT AS ref_id, NULL::BIGINT AS pred_id, []::BIGINT[] AS taken FROM (SELECT DISTINCT k FROM refs)
  UNION ALL SELECT k, n, ref_id, best, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END FROM (
    SELECT f.k, r.n, r.ref_id, f.taken, (SELECT arg_min(pairs.pred_id, (pairs.error, pairs.pf, pairs.pred_id)) FROM pairs WHERE pairs.k = f.k AND pairs.ref_id = r.ref_id AND NOT list_contains(f.taken, pairs.pred_id)) AS best FROM fold f JOIN refs r ON r.k = f.k AND r.n = f.n + 1)
), matched AS (SELECT f.k, f.ref_id, f.pred_id, pairs.error FROM fold f JOIN pairs ON pairs.k = f.k AND pairs.ref_id = f.ref_id AND pairs.pred_id = f.pred_id)"""


@query("joi09_greedy_match", MATCHED + " SELECT * FROM matched")
def joi09_match(spark, sf):
    return evaluation.greedy_match(evaluation.tolerance_pairs(_events(spark, sf, "click"), _events(spark, sf, "view"), ["k"], 12), ["k"], 12)


@query("agg25_detection_metrics", MATCHED + f""", c AS (SELECT (SELECT count(*) FROM p) AS predictions, (SELECT count(*) FROM q) AS "references", (SELECT count(*) FROM matched) AS true_positives, (SELECT avg(error) FROM matched) AS e, (SELECT median(error) FROM matched) AS median_error)
SELECT predictions, "references", true_positives, predictions - true_positives AS false_positives, "references" - true_positives AS false_negatives, {r('e', 'mean_error')}, median_error, {r('true_positives / predictions', 'precision')}, {r('true_positives / "references"', 'recall')} FROM c""")
def agg25(spark, sf):
    p, q = _events(spark, sf, "click"), _events(spark, sf, "view")
    m = evaluation.detection_metrics(p, q, joi09_match(spark, sf))
    return m.select("predictions", "references", "true_positives", "false_positives", "false_negatives", _r("mean_error"), "median_error", _r("precision"), _r("recall"))


@query("joi10_nearest", TRUTH + """ SELECT k, target, frame_id AS nearest FROM (SELECT p.k, p.frame_id AS target, q.frame_id, p.id FROM p JOIN q ON p.k = q.k QUALIFY row_number() OVER (PARTITION BY p.k, p.id ORDER BY abs(p.frame_id - q.frame_id), q.frame_id) = 1)""")
def joi10(spark, sf):
    d = evaluation.nearest_sample(_events(spark, sf, "click").select("k", F.col("frame_id").alias("target")), _events(spark, sf, "view"), ["k"])
    return d.where("nearest is not null")


@query("agg25_macro_f1", f"""WITH p AS (SELECT lang AS truth, CASE WHEN quality = 1 AND toxic = 0 THEN lang WHEN doc_id % 2 = 0 THEN 'en' END AS guess FROM labels JOIN documents USING (doc_id)), t AS (SELECT truth AS class, count(*) AS support, sum(CAST(truth = guess AS INT)) AS hits FROM p GROUP BY 1), g AS (SELECT guess AS class, count(*) AS guessed FROM p GROUP BY 1),
m AS (SELECT class, support, coalesce(hits, 0) / guessed AS precision, coalesce(hits, 0) / support AS recall FROM t LEFT JOIN g USING (class)) SELECT class, support, {r('precision')}, {r('recall')}, {r('2 * precision * recall / (precision + recall)', 'f1')} FROM m""")
def agg25_f1(spark, sf):
    d = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    guess = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("lang")).when(F.col("doc_id") % 2 == 0, "en")
    m = evaluation.macro_f1(d.select(F.col("lang").alias("truth"), guess.alias("guess")))
    return m.select("class", "support", *map(_r, ("precision", "recall", "f1")))


@query("agg22_reason_histogram", """SELECT user_id AS k, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL) GROUP BY user_id""")
def agg22(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("reason"))
    return evaluation.reason_histogram(e, ["k"], "reason")


@query("agg10_null_aware_stats", f"SELECT user_id AS k, {r('avg(v)', 'v_mean')}, {r('sqrt(avg(v * v))', 'v_rms')}, CASE WHEN count(v) >= 2 THEN round(stddev_pop(v) + 1e-10::DOUBLE, 6) END AS v_std FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN value END AS v FROM events) GROUP BY user_id")
def agg10(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return e.groupBy("k").agg(*evaluation.null_aware("v")).select("k", *map(_r, ("v_mean", "v_rms", "v_std")))


@query("win31_stratified_sample", """WITH a AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS t FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, user_id) AS p FROM a)
SELECT event_type, user_id, event_id FROM b ORDER BY p, event_type, user_id, event_id LIMIT 60""")
def win31(spark, sf):
    return evaluation.stratified_sample(views.table(spark, sf, "events").select("event_type", "user_id", "event_id"), ["event_type"], "user_id", ["event_id"], 60)


# ---- metadata

MATCHES = """WITH m AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'dup' ELSE CAST(o_orderkey AS VARCHAR) END AS match_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS tournament, CASE WHEN o_orderkey % 13 = 0 THEN '20x4' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 17 = 0 THEN '-5' ELSE '30' END AS fps FROM orders)"""


@query("prj25_metadata_validation", MATCHES + """ SELECT match_id, error, count(*) AS rows FROM (SELECT match_id, 'missing tournament' AS error FROM m WHERE tournament = '' UNION ALL SELECT match_id, 'year is not digits' FROM m WHERE NOT regexp_full_match(year, '[0-9]+') UNION ALL SELECT match_id, 'fps is not positive' FROM m WHERE fps <> 'unknown' AND coalesce(try_cast(fps AS DOUBLE), 0) <= 0
  UNION ALL SELECT match_id, 'duplicate match_id' FROM m GROUP BY match_id HAVING count(*) > 1) GROUP BY ALL""")
def prj25(spark, sf):
    from ..operators.metadata import metadata_errors

    k = F.col("o_orderkey")
    m = views.table(spark, sf, "orders").select(
        F.when(k % 50 == 0, "dup").otherwise(k.cast("string")).alias("match_id"), F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("tournament"),
        F.when(k % 13 == 0, "20x4").otherwise(F.year("o_orderdate").cast("string")).alias("year"), F.when(k % 7 == 0, "unknown").when(k % 17 == 0, "-5").otherwise("30").alias("fps"),
    )
    return metadata_errors(m, ["tournament"]).groupBy("match_id", "error").agg(F.count("*").alias("rows"))


@query("agg23_source_counts", f"SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'UNKNOWN') AS source, count(*) AS rows, min(o_totalprice) AS least, max(o_totalprice) AS most, {r('avg(o_totalprice)', 'mean', 4)} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg23(spark, sf):
    d = views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.groupBy(F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("UNKNOWN")).alias("source")).agg(F.count("*").alias("rows"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.avg("o_totalprice").alias("mean")).select("source", "rows", "least", "most", _r("mean", 4))


@query("joi14_tracker_pivot", f"WITH a AS (SELECT user_id AS k, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT k, {', '.join(r(f'max(v) FILTER (event_type = {chr(39)}{t}{chr(39)})', t) for t in ('click', 'error', 'view'))} FROM a GROUP BY k")
def joi14(spark, sf):
    d = views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).pivot("event_type", ["click", "error", "view"]).agg(F.avg("value"))
    return d.select("k", *map(_r, ("click", "error", "view")))


@query("orc05_resume_prefix", """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS stage, CASE WHEN max(l_quantity) > 45 THEN 'failed' ELSE 'success' END AS status FROM lineitem GROUP BY ALL) SELECT run_id, coalesce(min(stage) FILTER (status <> 'success'), max(stage) + 1) AS next_stage FROM s GROUP BY run_id""")
def orc05(spark, sf):
    s = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage")).agg(F.when(F.max("l_quantity") > 45, "failed").otherwise("success").alias("status"))
    return s.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("status") != "success", F.col("stage"))), F.max("stage") + 1).alias("next_stage"))


@query("str05_throttled_stats", "SELECT user_id AS k, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 86400.0) AS BIGINT) AS tick, count(*) AS rows, max(value) AS most FROM events GROUP BY ALL")
def str05(spark, sf):
    tick = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 86400).cast("bigint")
    return views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k"), tick.alias("tick")).agg(F.count("*").alias("rows"), F.max("value").alias("most"))


@query("agg38_stage_progress", """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS stage, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT run_id, CAST(sum(CAST(q <= 40 AS INT)) AS BIGINT) AS completed, count(*) AS total, min(stage) FILTER (q > 40) AS terminal FROM s GROUP BY run_id""")
def agg38(spark, sf):
    s = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage")).agg(F.max("l_quantity").alias("q"))
    return s.groupBy("run_id").agg(F.sum((F.col("q") <= 40).cast("int")).alias("completed"), F.count("*").alias("total"), F.min(F.when(F.col("q") > 40, F.col("stage"))).alias("terminal"))


@query("joi17_last_wins", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC) = 1")
def joi17(spark, sf):
    li = views.table(spark, sf, "lineitem")
    best = li.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_quantity")).alias("m"))
    return best.select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_quantity")


@query("joi19_event_hold", "WITH " + views.TRACK + """, e AS (SELECT k, frame_id AS f, event_id FROM track WHERE event_type = 'purchase') SELECT t.k, t.frame_id, max(f) AS event_frame FROM track t JOIN e ON e.k = t.k AND t.frame_id - f BETWEEN 0 AND 3 GROUP BY ALL""")
def joi19(spark, sf):
    t = views.track(spark, sf)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("frame_id")), True).over(Window.partitionBy("k").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("event_frame", last).where(F.col("frame_id") - F.col("event_frame") <= 3).select("k", "frame_id", "event_frame")
