"""Queries over detections: association folds, greedy selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking
from . import views

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _boxes(spark, sf):
    """Detections: orders of a customer are frames, lines of an order its boxes."""
    li, o = views.table(spark, sf, "lineitem"), views.table(spark, sf, "orders")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"x1": p % 600, "y1": q * 8})
    return d.select(F.col("o_custkey").alias("video"), F.col("l_orderkey").alias("frame_id"), "x1", "y1", (F.col("x1") + 40 + F.col("l_tax") * 300).alias("x2"), (F.col("y1") + 90).alias("y2"), (F.col("l_discount") * 10).alias("score"))


@query("trk03_assignment")
def trk3(spark, sf):
    return tracking.assign_players(_boxes(spark, sf), "video", 300.0)


DETECTIONS = "d AS (SELECT o_custkey AS video, l_orderkey AS frame_id, l_extendedprice % 600 AS x1, l_quantity * 8 AS y1, l_extendedprice % 600 + 40 + l_tax * 300 AS x2, l_quantity * 8 + 90 AS y2, l_discount * 10 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CHOSEN = f"""WITH RECURSIVE {DETECTIONS}, c AS (SELECT video, frame_id, x1 AS x, y1 AS y, score * 20 + 6 * (x2 - x1) + 30 * 0.5::DOUBLE AS b, dense_rank() OVER (PARTITION BY video ORDER BY frame_id) AS n FROM d), fr AS (SELECT DISTINCT video, n, frame_id FROM c), fold AS (
  SELECT video, 0::BIGINT AS n, NULL::BIGINT AS frame_id, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS vx, NULL::DOUBLE AS vy, NULL::DOUBLE AS value, false AS got FROM (SELECT DISTINCT video FROM c)
  UNION ALL SELECT video, n, frame_id, CASE WHEN best IS NULL THEN lx ELSE best.x END, CASE WHEN best IS NULL THEN ly ELSE best.y END, CASE WHEN best IS NULL THEN vx ELSE best.x - lx END, CASE WHEN best IS NULL THEN vy ELSE best.y - ly END, best.v, best IS NOT NULL
  FROM (SELECT f.video, fr.n, fr.frame_id, f.lx, f.ly, f.vx, f.vy, (SELECT arg_max(struct_pack(x := w.x, y := w.y, v := w.v), (w.v, -w.x, -w.y)) FROM (
      SELECT c.x, c.y, c.b - CASE WHEN f.lx IS NULL THEN 0 ELSE 1.2::DOUBLE * sqrt((c.x - f.lx - coalesce(f.vx, 0)) ** 2 + (c.y - f.ly - coalesce(f.vy, 0)) ** 2) END
        + CASE WHEN f.vx IS NOT NULL AND sqrt(f.vx ** 2 + f.vy ** 2) > 1 AND sqrt((c.x - f.lx) ** 2 + (c.y - f.ly) ** 2) > 1 THEN 8 * (f.vx * (c.x - f.lx) + f.vy * (c.y - f.ly)) / (sqrt(f.vx ** 2 + f.vy ** 2) * sqrt((c.x - f.lx) ** 2 + (c.y - f.ly) ** 2)) - 0.4::DOUBLE * abs(sqrt((c.x - f.lx) ** 2 + (c.y - f.ly) ** 2) - sqrt(f.vx ** 2 + f.vy ** 2)) ELSE 0 END AS v
      FROM c WHERE c.video = f.video AND c.n = fr.n AND (f.lx IS NULL OR sqrt((c.x - f.lx - coalesce(f.vx, 0)) ** 2 + (c.y - f.ly - coalesce(f.vy, 0)) ** 2) <= 250)) w) AS best
    FROM fold f JOIN fr ON fr.video = f.video AND fr.n = f.n + 1)
)"""


@query("trk07_choice", CHOSEN + " SELECT video, frame_id, lx AS x, ly AS y, round(value, 4) AS value FROM fold WHERE got")
def trk7(spark, sf):
    d = _boxes(spark, sf).select("video", "frame_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("score") * 20).alias("brightness"), (F.col("x2") - F.col("x1")).alias("area"), F.lit(0.5).alias("motion"))
    return tracking.choose_shuttle(d, "video", 250.0).withColumn("value", F.round("value", 4))


@query("trk15_plausible_boxes", """WITH b AS (SELECT l_orderkey, l_linenumber, 40 + l_tax * 300 AS w, 90::DOUBLE AS h, l_discount * 10 AS score FROM lineitem) SELECT l_orderkey, l_linenumber, round(score * 1000 - 4000 * (w * h / 2073600.0::DOUBLE) + 1e-10, 6) AS worth FROM b WHERE w * h / 2073600.0::DOUBLE <= 0.0025::DOUBLE AND greatest(w / h, h / w) <= 2""")
def trk15(spark, sf):
    b = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("l_tax") * 300 + 40).alias("x2"), F.lit(90.0).alias("y2"), (F.col("l_discount") * 10).alias("score"))
    return tracking.plausible_boxes(b, 2073600.0, 0.0025, 2.0).select("l_orderkey", "l_linenumber", F.round(F.col("worth") + 1e-10, 6).alias("worth"))


GATED = "WITH RECURSIVE " + views.TRACK + """, o AS (SELECT k, frame_id, x, y, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n FROM track), fold AS (
  SELECT k, frame_id, x, y, n, x AS lx, y AS ly, x AS px, y AS py, 0 AS gone, true AS is_kept FROM o WHERE n = 1
  UNION ALL SELECT k, frame_id, x, y, n, CASE WHEN far THEN lx ELSE x END, CASE WHEN far THEN ly ELSE y END, CASE WHEN far THEN px ELSE 2 * x - lx END, CASE WHEN far THEN py ELSE 2 * y - ly END, CASE WHEN far THEN gone + 1 ELSE 0 END, NOT far
  FROM (SELECT o.k, o.frame_id, o.x, o.y, o.n, lx, ly, px, py, gone, gone <= 5 AND (sqrt((o.x - lx) ** 2 + (o.y - ly) ** 2) > 60 OR sqrt((o.x - px) ** 2 + (o.y - py) ** 2) > 80) AS far FROM fold f JOIN o ON o.k = f.k AND o.n = f.n + 1)
)"""


@query("trk17_outlier_gate", GATED + " SELECT k, frame_id, x, y, is_kept FROM fold")
def trk17(spark, sf):
    return tracking.gate_outliers(views.track(spark, sf).select("k", "frame_id", "x", "y"), "k", 60.0, 80.0)


@query("trk19_region_players", """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 600 AS x1, l_quantity * 8 + 90 AS y2, l_discount * 10 AS score FROM lineitem) SELECT l_orderkey, CASE WHEN y2 < 300 THEN 'upper' ELSE 'lower' END AS region, y2, score, x1 FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey, region ORDER BY y2 DESC, score DESC, x1) = 1""")
def trk19(spark, sf):
    b = views.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") % 600).alias("x1"), (F.col("l_quantity") * 8 + 90).alias("y2"), (F.col("l_discount") * 10).alias("score"))
    return tracking.region_players(b, ["l_orderkey"], F.when(F.col("y2") < 300, "upper").otherwise("lower"))


CLUSTERED = f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT * REPLACE (round(score, 2) AS score), row_number() OVER (PARTITION BY video ORDER BY frame_id, round(score, 2) DESC, x1, y1) AS n FROM d), fold AS (
  SELECT video, n, frame_id, x1, y1, score, [struct_pack(x := x1, y := y1, at := frame_id, q := score)] AS leaders, 1::BIGINT AS c FROM o WHERE n = 1
  UNION ALL SELECT video, n, frame_id, x1, y1, score, CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(x := x1, y := y1, at := frame_id, q := score)) ELSE leaders END, coalesce(hit, len(leaders) + 1) FROM (
    SELECT o.*, f.leaders, list_position(list_transform(f.leaders, lambda l: sqrt(((l.x - o.x1) / 1920) ** 2 + ((l.y - o.y1) / 1080) ** 2) <= 0.04::DOUBLE), true) AS hit FROM fold f JOIN o ON o.video = f.video AND o.n = f.n + 1)
), members AS (SELECT video, c - 1 AS cluster, frame_id, max(score) AS quality, min(n) AS n FROM fold GROUP BY ALL),
sizes AS (SELECT video, cluster, count(*) AS size, sum(quality) AS total FROM members GROUP BY ALL), best AS (SELECT video, cluster, size FROM sizes QUALIFY row_number() OVER (PARTITION BY video ORDER BY size DESC, round(total, 6) DESC, cluster) = 1),
many AS (SELECT video, count(*) AS candidates FROM o GROUP BY video)"""


@query("cal08_clusters", CLUSTERED + """ SELECT m.video, m.frame_id, m.quality, m.cluster, candidates < 2 OR m.cluster = b.cluster AS is_stable,
  candidates >= 2 AND m.cluster = b.cluster AND b.size >= 2 AND row_number() OVER (PARTITION BY m.video, m.cluster ORDER BY quality DESC, n) = 1 AS is_chosen FROM members m JOIN best b USING (video) JOIN many USING (video)""")
def cal8(spark, sf):
    x, y = F.col("x1"), F.col("y1")
    corners = F.array(F.array(x, y), F.array(x + 600, y), F.array(x + 600, y + 400), F.array(x, y + 400))
    d = _boxes(spark, sf).select("video", "frame_id", corners.alias("corners"), F.round("score", 2).alias("quality"))
    return tracking.leader_clusters(d, "video", 0.04, 1920, 1080)


DEDUPED = f"""WITH RECURSIVE {DETECTIONS}, s AS (SELECT DISTINCT video, x1, y1, x2, y2 FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) DESC, x1, y1, x2, y2) AS n FROM s), fold AS (
  SELECT video, n, x1, y1, x2, y2, [struct_pack(a := x1, b := y1, c := x2, d := y2)] AS kept, true AS stays FROM o WHERE n = 1
  UNION ALL SELECT video, n, x1, y1, x2, y2, CASE WHEN fresh THEN list_append(kept, struct_pack(a := x1, b := y1, c := x2, d := y2)) ELSE kept END, fresh FROM (
    SELECT o.*, f.kept, len(list_filter(f.kept, lambda q: abs((q.a + q.c) / 2 - (o.x1 + o.x2) / 2) <= 20)) = 0 AS fresh FROM fold f JOIN o ON o.video = f.video AND o.n = f.n + 1)
)"""


@query("cal05_segment_dedupe", DEDUPED + " SELECT video, x1, y1, x2, y2 FROM fold WHERE stays")
def cal5(spark, sf):
    d = _boxes(spark, sf).select("video", "x1", "y1", "x2", "y2")
    return tracking.drop_near_segments(d, ["video"], 20.0)
