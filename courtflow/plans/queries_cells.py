"""Own entries of scalar cleaning, geometry and pose functions: cells of text as tables bring them, boxes, corners, joints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, pose, scores
from ..functions import geometry as g
from . import views
from .queries_play import BOXES, _boxes, _r, r
from .queries_pose import POSES, _poses, at

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- cells: each event's number as some text

CELLS = """WITH c AS (SELECT event_id, value, CASE event_id % 8 WHEN 0 THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.7 ' WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'x1' WHEN 4 THEN NULL WHEN 5 THEN CAST(event_id % 50 AS VARCHAR) WHEN 6 THEN 'inf' ELSE ' TRUE' END AS cell FROM events)"""


def _cells(spark, sf):
    n = F.col("event_id") % 8
    whole = F.floor("value").cast("bigint").cast("string")
    cell = F.when(n == 0, F.concat(F.lit(" "), whole, F.lit(".7 "))).when(n == 1, "").when(n == 2, "nan").when(n == 3, "x1").when(n == 5, (F.col("event_id") % 50).cast("string")).when(n == 6, "inf").when(n == 7, " TRUE")
    return views.table(spark, sf, "events").select("event_id", "value", cell.alias("cell"))


@query("prj02_integers", CELLS + " SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(floor(value) AS BIGINT) WHEN 5 THEN event_id % 50 ELSE -1 END AS number FROM c")
def prj02(spark, sf):
    return _cells(spark, sf).select("event_id", coerce.integer("cell", -1).alias("number"))


@query("prj03_finite_numbers", CELLS + " SELECT event_id, CASE event_id % 8 WHEN 0 THEN floor(value) + 0.7::DOUBLE WHEN 5 THEN CAST(event_id % 50 AS DOUBLE) END AS number FROM c")
def prj03(spark, sf):
    return _cells(spark, sf).select("event_id", coerce.finite("cell").alias("number"))


@query("prj04_truth", CELLS + " SELECT event_id, coalesce(lower(trim(cell)) IN ('1', 'true', 'yes'), false) AS truth FROM c")
def prj04(spark, sf):
    return _cells(spark, sf).select("event_id", coerce.truthy("cell").alias("truth"))


@query("prj05_rounded", CELLS + " SELECT event_id, CASE WHEN event_id % 8 IN (2, 6) THEN NULL ELSE round(value / 7, 3) END AS number FROM c")
def prj05(spark, sf):
    x = F.when(F.col("event_id") % 8 == 2, float("nan")).when(F.col("event_id") % 8 == 6, float("inf")).otherwise(F.col("value") / 7)
    return _cells(spark, sf).select("event_id", coerce.rounded(x).alias("number"))


STEMS = "WITH s AS (SELECT o_orderkey, o_custkey % 1000 AS n, CASE o_orderkey % 4 WHEN 0 THEN 'A B rally_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'match one_rally_' || CAST(o_custkey % 1000 AS VARCHAR) || '_cut' WHEN 2 THEN 'a name without any number' ELSE '' END AS stem FROM orders)"


def _stems(spark, sf):
    n, k = (F.col("o_custkey") % 1000).cast("string"), F.col("o_orderkey") % 4
    stem = F.when(k == 0, F.concat(F.lit("A B rally_"), F.lpad(n, 3, "0"))).when(k == 1, F.concat(F.lit("match one_rally_"), n, F.lit("_cut"))).when(k == 2, "a name without any number").otherwise("")
    return views.table(spark, sf, "orders").select("o_orderkey", stem.alias("stem"))


@query("prj07_player_rally_id", STEMS.replace("'A B rally_'", "'A B_rally_'") + " SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE '000' END AS rally_id FROM s")
def prj07(spark, sf):
    return _stems(spark, sf).select("o_orderkey", coerce.rally_id(F.replace("stem", F.lit(" rally"), F.lit("_rally"))).alias("rally_id"))


@query("prj08_chart_label", STEMS + " SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'r007' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'r' || lpad(CAST(n AS VARCHAR), 3, '0') WHEN 1 THEN 'r' || CAST(n AS VARCHAR) WHEN 2 THEN 't any number' ELSE 'unknown' END END AS label FROM s")
def prj08(spark, sf):
    return _stems(spark, sf).select("o_orderkey", coerce.chart_label(F.when(F.col("o_orderkey") % 5 == 0, "007").otherwise(""), "stem").alias("label"))


@query("prj09_match_id", STEMS + " SELECT o_orderkey, replace(stem, ' ', '_') AS match_id FROM s")
def prj09(spark, sf):
    return _stems(spark, sf).select("o_orderkey", coerce.match_id("stem").alias("match_id"))


LEGACY = "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS VARCHAR) ELSE '' END AS ground_image_x, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 AS VARCHAR) END AS image_x, CAST(event_id % 80 AS VARCHAR) AS image_y, '0.5' AS confidence FROM events)"


@query("prj11_legacy_rows", LEGACY + """ SELECT event_id, CASE WHEN ground_image_x = '' THEN coalesce(image_x, '') ELSE ground_image_x END AS ground_image_x, CASE WHEN ground_image_x = '' THEN '2.0-adapted-legacy' END AS schema_version,
  CASE WHEN ground_image_x = '' THEN CASE WHEN image_x IS NOT NULL THEN '1' ELSE '0' END END AS ground_anchor_valid, CASE WHEN ground_image_x = '' THEN 'legacy_image_xy' END AS ground_anchor_source, CASE WHEN ground_image_x = '' THEN '0' END AS body_anchor_valid FROM t""")
def prj11(spark, sf):
    e = F.col("event_id")
    ground = F.when(e % 3 == 0, (e % 100).cast("string")).otherwise("")
    t = views.table(spark, sf, "events").select("event_id", ground.alias("ground_image_x"), F.when(e % 2 == 0, (e % 90).cast("string")).alias("image_x"), (e % 80).cast("string").alias("image_y"), F.lit("0.5").alias("confidence"))
    return coerce.adapt_legacy(t).select("event_id", "ground_image_x", "schema_version", "ground_anchor_valid", "ground_anchor_source", "body_anchor_valid")


#: Track rows as text: smoothed coordinates are blank for a third, flags vary.
TEXT_TRACK = (
    "WITH " + views.TRACK + """, t AS (SELECT k, frame_id, frame_id * 2 AS raw, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(frame_id * 2 + 1 AS VARCHAR) END AS sx, CAST(frame_id * 2 AS VARCHAR) AS x, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(frame_id AS VARCHAR) END AS y, '' AS sy,
  CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'True' WHEN 2 THEN '0' END AS ok, event_id FROM track)"""
)


def _text_track(spark, sf):
    e, f = F.col("event_id"), F.col("frame_id")
    return views.track(spark, sf).select(
        "k", "frame_id", "event_id", F.when(e % 3 == 0, "").otherwise((f * 2 + 1).cast("string")).alias("sx"), (f * 2).cast("string").alias("x"), F.when(e % 7 == 0, "bad").otherwise(f.cast("string")).alias("y"), F.lit("").alias("sy"),
        F.when(e % 4 == 0, "1").when(e % 4 == 1, "True").when(e % 4 == 2, "0").alias("ok"),
    )


@query("prj13_court_point", TEXT_TRACK + " SELECT k, frame_id, CASE WHEN ok IN ('1', 'True') THEN CASE WHEN event_id % 3 <> 0 THEN raw + 1.0 END ELSE raw END::DOUBLE AS x FROM t")
def prj13(spark, sf):
    t = _text_track(spark, sf).withColumns({"a": coerce.number("sx"), "b": coerce.number("x")})
    return t.select("k", "frame_id", coerce.court_point(coerce.literal_true("ok"), ("a", "a"), ("b", "b"))["x"].alias("x"))


@query("prj14_image_point", TEXT_TRACK + " SELECT k, frame_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN raw ELSE raw + 1 END END::DOUBLE AS x, CASE WHEN event_id % 7 <> 0 THEN frame_id END::DOUBLE AS y FROM t")
def prj14(spark, sf):
    p = coerce.either_point(("sx", "sy"), ("x", "y"))
    return _text_track(spark, sf).select("k", "frame_id", p["x"].alias("x"), p["y"].alias("y"))


@query("prj15_shuttle_point", TEXT_TRACK + " SELECT k, frame_id, CASE WHEN ok IN ('1', 'True') AND event_id % 7 <> 0 THEN raw END::DOUBLE AS smoothed_table_x, CASE WHEN coalesce(ok, '1') <> '0' AND event_id % 7 <> 0 THEN raw END::DOUBLE AS raw_table_x FROM t")
def prj15(spark, sf):
    s, plain = coerce.shuttle_point(("sx", "sy"), ("x", "y"), smoothed_valid="ok"), coerce.shuttle_point(("sx", "sy"), ("x", "y"), visible="ok")
    return _text_track(spark, sf).select("k", "frame_id", s["x"].alias("smoothed_table_x"), plain["x"].alias("raw_table_x"))


@query("prj16_usable_shuttle", TEXT_TRACK + " SELECT k, frame_id, CASE WHEN event_id % 3 = 0 THEN raw ELSE raw + 1 END::DOUBLE AS x, row_number() OVER (PARTITION BY k ORDER BY frame_id) AS n FROM t WHERE ok IN ('1', 'True') AND event_id % 7 <> 0")
def prj16(spark, sf):
    from ..operators import movement

    return movement.usable_shuttle(_text_track(spark, sf), ["k"]).select("k", "frame_id", "x", "n")


@query("prj19_observed_shuttle", TEXT_TRACK + " SELECT k, frame_id, coalesce(event_id % 5 <> 0 AND lower(ok) IN ('1', 'true') AND (frame_id % 10) / 10.0::DOUBLE >= 0.3::DOUBLE AND event_id % 7 <> 0, false) AS observed FROM t")
def prj19(spark, sf):
    t = _text_track(spark, sf)
    seen = coerce.shuttle_observed(F.when(F.col("event_id") % 5 == 0, "yes").otherwise(""), "ok", ((F.col("frame_id") % 10) / 10).cast("string"), "x", "y", 0.3)
    return t.select("k", "frame_id", seen.alias("observed"))


@query("prj20_chart_points", f"WITH {views.PLAYER} SELECT rally_id, player_id, frame_id, CASE WHEN event_id % 3 = 0 THEN court_x ELSE court_x + 0.1::DOUBLE END AS x FROM player WHERE event_id % 4 <> 2 AND confidence >= 0.5 AND CASE WHEN event_id % 3 = 0 THEN court_x ELSE court_x + 0.1::DOUBLE END <= 6.10 AND court_x >= 0 AND court_y BETWEEN 0 AND 13.4")
def prj20(spark, sf):
    from ..operators import movement

    p = views.player(spark, sf).withColumns({
        "is_smoothed_valid": F.when(F.col("event_id") % 4 == 2, 0).otherwise(1), "smoothed_court_x": F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("court_x") + 0.1), "smoothed_court_y": F.lit(None).cast("double"),
    })
    return movement.chart_points(p, 0.5).select("rally_id", "player_id", "frame_id", "x")


@query("prj24_required_columns", "SELECT * FROM (VALUES ('lineitem', 'l_tax_code'), ('lineitem', 'l_colour')) AS m(name, missing)")
def prj24(spark, sf):
    from ..sources import tables

    missing = tables.missing_columns(views.table(spark, sf, "lineitem").columns, ["l_orderkey", "l_tax_code", "l_tax", "l_colour"])
    return spark.createDataFrame([("lineitem", m) for m in missing], "name string, missing string")


@query("prj28_review_template", "SELECT o_orderkey AS rally_id, o_custkey AS match_id, 'pending' AS review_status, '' AS corrected_start_time, '' AS corrected_end_time, '' AS review_notes FROM orders")
def prj28(spark, sf):
    from ..operators import metadata

    return metadata.review_template(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rally_id"), F.col("o_custkey").alias("match_id"), F.lit(1).alias("other")), ["rally_id", "match_id"])


@query("prj30_cookie_routing", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'yt.txt' WHEN 1 THEN 'yt.txt' ELSE 'default.txt' END AS cookies FROM pages")
def prj30(spark, sf):
    n = F.col("page_id") % 4
    url = F.when(n == 0, "https://www.YouTube.com/a").when(n == 1, "https://youtu.be/b").when(n == 2, "https://olympics.com/c").otherwise("https://example.com")
    return views.table(spark, sf, "pages").select("page_id", coerce.cookie_source(url, F.lit("default.txt"), F.lit("yt.txt")).alias("cookies"))


@query("prj31_safe_name", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A_b-' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'event' ELSE repeat('y', 120) END AS name FROM orders")
def prj31(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("._A (b-"), k.cast("string"), F.lit("!."))).when(k % 3 == 1, " ?? ").otherwise(F.lit("y" * 130))
    name = coerce.safe_name(F.replace(raw, F.lit(" ("), F.lit(" ")))
    return views.table(spark, sf, "orders").select("o_orderkey", name.alias("name"))


@query("prj32_number_labels", CELLS + " SELECT event_id, CASE WHEN event_id % 8 = 4 THEN '—' ELSE printf('%.2f', floor(value) + 0.25::DOUBLE) END AS label FROM c")
def prj32(spark, sf):
    return _cells(spark, sf).select("event_id", coerce.number_label(F.when(F.col("event_id") % 8 != 4, F.floor("value") + 0.25)).alias("label"))


@query("prj33_percent_labels", CELLS + " SELECT event_id, CASE WHEN event_id % 8 = 4 THEN '—' ELSE printf('%.1f%%', (event_id % 8) * 12.5::DOUBLE) END AS label FROM c")
def prj33(spark, sf):
    return _cells(spark, sf).select("event_id", coerce.percent_label(F.when(F.col("event_id") % 8 != 4, (F.col("event_id") % 8) / 8)).alias("label"))


@query("prj34_duration_labels", """WITH c AS (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders), m AS (SELECT *, greatest(1, (s + 30) // 60) AS m FROM c) SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '—' WHEN s < 60 THEN CAST(s AS VARCHAR) || ' 秒' WHEN m >= 60 THEN printf('%d 小时 %d 分钟', m // 60, m % 60) ELSE printf('%d 分钟', m) END AS exact,
  CASE WHEN o_orderkey % 11 = 0 THEN '—' WHEN s < 60 THEN '不足 1 分钟' WHEN m >= 60 THEN printf('约 %d 小时 %d 分钟', m // 60, m % 60) ELSE printf('约 %d 分钟', m) END AS about FROM m""")
def prj34(spark, sf):
    s = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 9000)
    return views.table(spark, sf, "orders").select("o_orderkey", coerce.duration_label(s).alias("exact"), coerce.duration_label(s, approximate=True).alias("about"))


@query("sup21_ratio", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 7) / (o_orderkey % 5) END AS ratio FROM orders")
def sup21(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", coerce.ratio(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("ratio"))


@query("sup23_coordinates", TEXT_TRACK + " SELECT k, frame_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN raw + 1 ELSE raw END::DOUBLE AS x FROM t")
def sup23(spark, sf):
    t = _text_track(spark, sf).withColumns({"a": coerce.number("sx"), "b": coerce.number("y"), "c": coerce.number("x")})
    return t.select("k", "frame_id", coerce.preferred_point(F.lit(True), ("a", "b"), ("c", "c"))["x"].alias("x"))


@query("sup31_roi", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.25::DOUBLE END AS x, CASE o_orderkey % 4 WHEN 0 THEN 0.5::DOUBLE END AS height FROM orders")
def sup31(spark, sf):
    n = F.col("o_orderkey") % 4
    roi = coerce.unit_roi(F.when(n == 0, " 0.25,0.1 ,0.5,0.5").when(n == 1, "0.6,0,0.5,1").when(n == 2, "0.1,0.2,0.3").otherwise("a,0,1,1"))
    return views.table(spark, sf, "orders").select("o_orderkey", F.get(roi, F.lit(0)).alias("x"), F.get(roi, F.lit(3)).alias("height"))


@query("sup32_playlist", "SELECT o_orderkey, o_orderkey % 3 = 0 AS playlist FROM orders")
def sup32(spark, sf):
    cell = F.when(F.col("o_orderkey") % 3 == 0, " PlayList ").when(F.col("o_orderkey") % 3 == 1, "final")
    return views.table(spark, sf, "orders").select("o_orderkey", coerce.is_playlist(cell).alias("playlist"))


@query("sup33_entries", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS items FROM orders")
def sup33(spark, sf):
    n = F.col("o_orderkey") % 3
    entries = F.when(n == 1, F.array(F.lit("a"), F.lit(None), F.lit("b"))).when(n == 2, F.array(F.lit(None).cast("string")))
    return views.table(spark, sf, "orders").select("o_orderkey", coerce.entry_count(entries).alias("items"))


@query("sup35_analysis_mode", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'near_only' ELSE 'experimental_two_player' END AS mode FROM orders")
def sup35(spark, sf):
    roles = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("near"), F.lit("near"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("near"), F.lit("far"))).otherwise(F.array(F.lit("far")))
    return views.table(spark, sf, "orders").select("o_orderkey", scores.mode_for_roles(roles).alias("mode"))


# ---- geometry

QUAD_SQL = BOXES + ", q AS (SELECT l_orderkey, l_linenumber, 100 + u1 AS xa, 50 + v1 AS ya, 500 + x1 AS xb, 60 + y1 AS yb, 620 + u1 AS xc, 400 + v1 AS yc, 20 + x1 AS xd, 380 + y1 AS yd FROM b)"


def _quads(spark, sf):
    c = F.col
    d = _boxes(spark, sf).select("l_orderkey", "l_linenumber", (c("u1") + 100).alias("ax"), (c("v1") + 50).alias("ay"), (c("x1") + 500).alias("bx"), (c("y1") + 60).alias("by"), (c("u1") + 620).alias("cx"), (c("v1") + 400).alias("cy"), (c("x1") + 20).alias("dx"), (c("y1") + 380).alias("dy"))
    return d, [(c("ax"), c("ay")), (c("bx"), c("by")), (c("cx"), c("cy")), (c("dx"), c("dy"))]


@query("geo02_image_to_court", BOXES + f" SELECT l_orderkey, l_linenumber, {r('CASE WHEN abs(x1 - 20) >= 1e-9 THEN (x1 + 2 * y1) / (x1 - 20) END', 'x')}, {r('CASE WHEN abs(x1 - 20) >= 1e-9 THEN (3 * y1 - 1) / (x1 - 20) END', 'y')} FROM b")
def geo02(spark, sf):
    x, y = g.project([[1, 2, 0], [0, 3, -1], [1, 0, -20]], F.col("x1"), F.col("y1"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x"), _r("y"))


@query("sup03_overlay_projection", BOXES + f" SELECT l_orderkey, l_linenumber, {r('(2 * x1 + 5) / (0.01::DOUBLE * y1 + 1)', 'x')} FROM b")
def sup03(spark, sf):
    x, _ = g.project([[2, 0, 5], [0, 1, 0], [0, 0.01, 1]], F.col("x1"), F.col("y1"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", _r("x"))


@query("geo04_court_to_image", BOXES + f", m AS (SELECT *, u1 - 3 AS px, v1 + 2 AS py FROM b) SELECT l_orderkey, l_linenumber, {r('(1.1::DOUBLE * px - 0.1::DOUBLE * py) / 0.985::DOUBLE', 'x', 4)}, {r('(0.9::DOUBLE * py - 0.05::DOUBLE * px) / 0.985::DOUBLE', 'y', 4)} FROM m")
def geo04(spark, sf):
    x, y = g.project(g.inverse([[0.9, 0.1, 3.0], [0.05, 1.1, -2.0], [0.0, 0.0, 1.0]]), F.col("u1"), F.col("v1"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x", 4), _r("y", 4))


@query("sup39_tracking_projection", BOXES + f" SELECT l_orderkey, l_linenumber, {r('(x1 * 0.5::DOUBLE + 1) / (0.002::DOUBLE * y1 + 1)', 'x', 4)} FROM b")
def sup39(spark, sf):
    x, _ = g.project([[0.5, 0, 1], [0, 0.5, 1], [0, 0.002, 1]], F.col("x1"), F.col("y1"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", _r("x", 4))


@query("geo05_court_mapper", BOXES + f" SELECT l_orderkey, l_linenumber, {r('u1 / 40 * 6.10::DOUBLE', 'x', 2)}, {r('v1 / 17 * 13.40::DOUBLE', 'y', 2)} FROM b")
def geo05(spark, sf):
    h = g.perspective([(100, 50), (140, 50), (140, 67), (100, 67)], [(0, 0), (6.10, 0), (6.10, 13.40), (0, 13.40)])
    x, y = g.project(h, F.col("u1") + 100, F.col("v1") + 50)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x", 2), _r("y", 2))


def _mid(c: str, a: str, b: str) -> str:
    return f"(({at(a)}.{c} + {at(b)}.{c}) / 2)"


LEAN = f", m AS (SELECT *, {_mid('x', 'left_shoulder', 'right_shoulder')} AS sx, {_mid('y', 'left_shoulder', 'right_shoulder')} AS sy, {_mid('x', 'left_hip', 'right_hip')} AS hx, {_mid('y', 'left_hip', 'right_hip')} AS hy, {_mid('x', 'left_ankle', 'right_ankle')} AS ax, {at('left_ankle')}.x - {at('right_ankle')}.x AS feet FROM good)"


@query("geo07_trunk_lean", POSES + LEAN + f" SELECT vec_id, {r('CASE WHEN sx IS NOT NULL AND hx IS NOT NULL THEN degrees(atan2(sx - hx, hy - sy)) END', 'lean', 4)} FROM m")
def geo07(spark, sf):
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", pose.trunk_lean(F.col("g")).alias("lean")).select("vec_id", _r("lean", 4))


@query("geo08_midpoints", POSES + LEAN + f" SELECT vec_id, {r('sx', 'x')}, {r('sy', 'y')} FROM m")
def geo08(spark, sf):
    x, y = pose.midpoint(F.col("g"), "left_shoulder", "right_shoulder")
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", x.alias("x"), y.alias("y")).select("vec_id", _r("x"), _r("y"))


@query("geo10_box_height", BOXES + f" SELECT l_orderkey, l_linenumber, {r('CASE WHEN y2 - y1 > 1e-9 THEN y2 - y1 END', 'height')} FROM b")
def geo10(spark, sf):
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.box_height(F.col("y1"), F.col("y2")).alias("height")).select("l_orderkey", "l_linenumber", _r("height"))


@query("geo11_stability", POSES + LEAN + f" SELECT vec_id, {r('abs(feet) / 50', 'support')}, {r('CASE WHEN sx IS NOT NULL AND hx IS NOT NULL THEN ((sx + hx) / 2 - ax) / 50 END', 'offset_ratio')} FROM m")
def geo11(spark, sf):
    width, offset = pose.stability(F.col("g"), F.lit(50.0))
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", width.alias("support"), offset.alias("offset_ratio")).select("vec_id", _r("support"), _r("offset_ratio"))


@query("geo14_own_depth", f"WITH {views.PLAYER} SELECT rally_id, frame_id, {r('least(6.7::DOUBLE, greatest(0, CASE WHEN frame_id % 2 = 0 THEN court_y - 6.7::DOUBLE ELSE 6.7::DOUBLE - court_y END))', 'depth')} FROM player")
def geo14(spark, sf):
    side = F.when(F.col("frame_id") % 2 == 0, "near").otherwise("far")
    return views.player(spark, sf).select("rally_id", "frame_id", g.own_depth(side, F.col("court_y")).alias("depth")).select("rally_id", "frame_id", _r("depth"))


@query("geo17_distance", BOXES + f" SELECT l_orderkey, l_linenumber, {r('sqrt((u1 - x1) ** 2 + (v1 - y1) ** 2)', 'distance')} FROM b")
def geo17(spark, sf):
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.distance(F.col("x1"), F.col("y1"), F.col("u1"), F.col("v1")).alias("distance")).select("l_orderkey", "l_linenumber", _r("distance"))


SHIFTED = ", s AS (SELECT l_orderkey, l_linenumber, least(greatest(round(x1 + u1 - 10), 0), 58) AS x1, least(greatest(round(y1 + v1 - 10), 0), 38) AS y1, round(x2 + u1 - 10) AS x2, round(y2 + v1 - 10) AS y2 FROM b)"


@query("geo18_shifted_box", BOXES + SHIFTED + " SELECT l_orderkey, l_linenumber, x1, y1, greatest(x1 + 1, least(x2, 59)) AS x2, greatest(y1 + 1, least(y2, 39)) AS y2 FROM s")
def geo18(spark, sf):
    box = g.shift_box(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("u1") - 10, F.col("v1") - 10, 60, 40)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))))


@query("geo19_clamped_box", BOXES + f" SELECT l_orderkey, l_linenumber, {r('least(x1, 28)', 'x1')}, {r('least(y1, 8)', 'y1')}, {r('greatest(least(x1, 28) + 1, least(x2, 29))', 'x2')}, {r('greatest(least(y1, 8) + 1, least(y2, 9))', 'y2')} FROM b")
def geo19(spark, sf):
    box = g.clamp_box(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), 30, 10)
    names = ("x1", "y1", "x2", "y2")
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(box, names))).select("l_orderkey", "l_linenumber", *map(_r, names))


@query("geo20_bottom_centre", BOXES + f" SELECT l_orderkey, l_linenumber, {r('(x1 + x2) / 2', 'x')}, {r('y2', 'y')} FROM b")
def geo20(spark, sf):
    x, y = g.bottom_centre(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x"), _r("y"))


@query("geo25_ramps", BOXES + f" SELECT l_orderkey, l_linenumber, {r('least(1, greatest(0, (x1 - 10) / 30))', 'ramp')}, {r('least(30, greatest(12, x1))', 'clamped')} FROM b")
def geo25(spark, sf):
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.ramp(F.col("x1"), 10, 40).alias("ramp"), g.clamp(F.col("x1"), 12, 30).alias("clamped")).select("l_orderkey", "l_linenumber", _r("ramp"), _r("clamped"))


@query("geo26_court_score", BOXES + ", p AS (SELECT l_orderkey, l_linenumber, u1 / 80 AS a, x1 / 50 AS sx, y1 / 13 AS sy, v1 / 100 AS l, y2 / 150 AS m FROM b)" + f""" SELECT l_orderkey, l_linenumber, {r('''0.45::DOUBLE * least(1, greatest(0, (a - 0.10::DOUBLE) / 0.30::DOUBLE)) + 0.35::DOUBLE * least(least(1, greatest(0, (sx - 0.42::DOUBLE) / 0.40::DOUBLE)), least(1, greatest(0, (sy - 0.35::DOUBLE) / 0.40::DOUBLE)))
  + 0.20::DOUBLE * least(least(1, greatest(0, (l - 0.07::DOUBLE) / 0.08::DOUBLE)), least(1, greatest(0, (m - 0.10::DOUBLE) / 0.10::DOUBLE)))''', 'score')} FROM p""")
def geo26(spark, sf):
    s = scores.court_score(F.col("u1") / 80, F.col("x1") / 50, F.col("y1") / 13, F.col("v1") / 100, F.col("y2") / 150)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", s.alias("score")).select("l_orderkey", "l_linenumber", _r("score"))


@query("geo28_stability_score", BOXES + f" SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 0.75::DOUBLE ELSE least(1, greatest(0, 1 - sqrt((x1 - u1) ** 2 + (y1 - v1) ** 2) / 500 / 0.08::DOUBLE)) END', 'score')} FROM b")
def geo28(spark, sf):
    moved = g.mean_corner_distance([(F.col("x1"), F.col("y1"))] * 4, [(F.col("u1"), F.col("v1"))] * 4)
    s = scores.stability_score(moved, F.col("l_linenumber") != 1, F.col("l_linenumber") != 2, 300, 400)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", s.cast("double").alias("score")).select("l_orderkey", "l_linenumber", _r("score"))


@query("geo29_reject_reason", BOXES + ", p AS (SELECT l_orderkey, l_linenumber, u1 / 40 AS c, v1 / 17 AS g, x1 / 50 AS l, y1 / 13 AS j, x2 / 100 AS m FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN m >= 0.5 AND j < 0.65 THEN '' WHEN j >= 0.65 THEN 'likely_closeup_or_replay' WHEN g < 0.45 THEN 'low_court_geometry_score' WHEN c < 0.45 THEN 'low_court_score' WHEN l < 0.35 THEN 'player_layout_invalid' ELSE 'low_main_view_score' END AS reason FROM p")
def geo29(spark, sf):
    parts = {"court": F.col("u1") / 40, "geometry": F.col("v1") / 17, "layout": F.col("x1") / 50, "reject": F.col("y1") / 13}
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", scores.view_reason(parts, F.col("x2") / 100, 0.5, 0.65).alias("reason"))


@query("geo32_corner_order", BOXES + " SELECT l_orderkey, l_linenumber, u1 < x2 AND x1 < x1 + v1 AND v1 + y1 < y2 + 8 AND u1 + x1 < x2 + x1 + v1 AS ordered FROM b")
def geo32(spark, sf):
    c = F.col
    ordered = scores.ordered_corners([(c("u1"), c("v1")), (c("x2"), c("y1")), (c("x1") + c("v1"), c("y2")), (c("x1"), F.lit(8.0))])
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", ordered.alias("ordered"))


@query("geo33_calibration_reasons", QUAD_SQL + """ SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN xc >= 640 OR yc >= 410 THEN 'corners_out_of_bounds' END, CASE WHEN l_linenumber = 3 THEN 'corners_wrong_order' END,
  CASE WHEN abs(xa * yb - xb * ya + xb * yc - xc * yb + xc * yd - xd * yc + xd * ya - xa * yd) / 2 / (640 * 410) < 0.5::DOUBLE THEN 'court_area_too_small' END, CASE WHEN l_linenumber % 4 = 0 THEN 'court_line_support_too_low' END) AS reasons FROM q""")
def geo33(spark, sf):
    d, c = _quads(spark, sf)
    support = F.when(F.col("l_linenumber") % 4 == 0, 0.1).otherwise(0.5)
    turned = [(F.when(F.col("l_linenumber") == 3, b[0]).otherwise(a[0]), F.when(F.col("l_linenumber") == 3, b[1]).otherwise(a[1])) for a, b in zip(c, [c[3], c[0], c[1], c[2]])]
    reasons = scores.calibration_reasons(turned, 640, 410, support, least_area=0.5)
    return d.select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("reasons"))


@query("geo34_unit_corners", BOXES + f" SELECT l_orderkey, l_linenumber, {r('CASE WHEN x1 <= 40 THEN x1 / 40 * 1920 END', 'x')}, {r('v1 / 17 * 1080', 'y')} FROM b")
def geo34(spark, sf):
    c = F.col
    x = g.unit_to_pixels([(c("x1") / 40, c("v1") / 17), (F.lit(0.5), F.lit(0.5)), (F.lit(1.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0))], 1920, 1080)[0][0]
    y = g.unit_to_pixels([(c("x1") / 40, c("v1") / 17)], 1920, 1080, out_of_bounds=True)[0][1]
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", _r("x"), _r("y"))


@query("geo35_model_lines", BOXES + f" SELECT l_orderkey, l_linenumber, {r('u1', 'left', 4)}, {r('u1 + 610', 'right', 4)}, {r('v1', 'top', 4)}, {r('v1 + 1340', 'bottom', 4)} FROM b")
def geo35(spark, sf):
    """Lines of a court seen from straight above, a metre a hundred pixels; the corners follow from the singles and service lines."""
    u, v = F.col("u1"), F.col("v1")
    along = [(m, (u + m * 100, v + 7, u + m * 100, v + 900)) for m in (0.46, 5.64)]
    across = [(m, (u + 3, v + m * 100, u + 400, v + m * 100)) for m in (4.72, 8.68)]
    c = g.court_corners_from_lines(along, across)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", c[0][0].alias("left"), c[1][0].alias("right"), c[0][1].alias("top"), c[2][1].alias("bottom")).select("l_orderkey", "l_linenumber", *(_r(n, 4) for n in ("left", "right", "top", "bottom")))


LINES = """lines AS (SELECT * FROM (VALUES ('far_baseline', 0, 0, 6.1, 0), ('right_doubles_sideline', 6.1, 0, 6.1, 13.4), ('near_baseline', 6.1, 13.4, 0, 13.4), ('left_doubles_sideline', 0, 13.4, 0, 0), ('left_singles_sideline', 0.46, 0, 0.46, 13.4),
  ('right_singles_sideline', 5.64, 0, 5.64, 13.4), ('far_doubles_long_service', 0, 0.76, 6.1, 0.76), ('near_doubles_long_service', 0, 12.64, 6.1, 12.64), ('far_short_service', 0, 4.72, 6.1, 4.72), ('near_short_service', 0, 8.68, 6.1, 8.68),
  ('far_center', 3.05, 0, 3.05, 4.72), ('near_center', 3.05, 8.68, 3.05, 13.4), ('net', 0, 6.7, 6.1, 6.7)) AS l(name, x1, y1, x2, y2))"""


@query("geo37_projected_lines", BOXES + f", {LINES} SELECT l_orderkey, l_linenumber, name, {r('b.x1 + l.x1::DOUBLE / 6.1::DOUBLE * 610', 'px', 4)}, {r('b.y1 + l.y2::DOUBLE / 13.4::DOUBLE * 670', 'py', 4)} FROM b, lines l WHERE l_linenumber = 1")
def geo37(spark, sf):
    x, y = F.col("x1"), F.col("y1")
    lines = g.projected_lines([(x, y), (x + 610, y), (x + 610, y + 670), (x, y + 670)])
    d = _boxes(spark, sf).where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.explode(lines).alias("l"))
    return d.select("l_orderkey", "l_linenumber", "l.name", F.col("l.x1").alias("px"), F.col("l.y2").alias("py")).select("l_orderkey", "l_linenumber", "name", _r("px", 4), _r("py", 4))


@query("geo40_expected_region", BOXES + " SELECT l_orderkey, l_linenumber, u1 / 4 - 1 BETWEEN -0.5 AND 6.6 AND v1 - 1 BETWEEN -0.5 AND 13.9 AS on_court FROM b")
def geo40(spark, sf):
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.in_court(F.col("u1") / 4 - 1, F.col("v1") - 1, 0.5).alias("on_court"))


# ---- keypoints

@query("arr03_built_keypoints", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 17 END AS joints, CASE WHEN vec_id % 5 <> 0 THEN round(list_sum(list_transform(embedding[35:51], lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(v AS DOUBLE) * 4)))), 4) END AS sure FROM embeddings")
def arr03(spark, sf):
    e = views.table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    points = F.transform(F.sequence(F.lit(1), F.when(F.col("vec_id") % 5 == 0, 16).otherwise(17)), lambda i: F.array(F.get(F.col("v"), i), F.get(F.col("v"), i + 17)))
    k = pose.build(points, F.transform(F.slice("v", 35, 17), lambda x: x * 4))
    return e.select("vec_id", k.alias("k")).select("vec_id", F.when(F.col("k").isNotNull(), F.size("k")).alias("joints"), F.round(F.aggregate("k", F.lit(0.0), lambda a, p: a + p["confidence"]), 4).alias("sure"))


@query("arr05_mean_confidence", POSES + f" SELECT vec_id, {r('coalesce(list_avg(list_transform(list_filter(k, lambda p: p.confidence >= 0.5), lambda p: p.confidence)), 0)', 'mean')} FROM poses")
def arr05(spark, sf):
    return _poses(spark, sf).select("vec_id", pose.mean_confidence(pose.valid(F.col("k"), 0.5)).alias("mean")).select("vec_id", _r("mean"))


@query("arr06_named_points", POSES + f" SELECT vec_id, len(g) AS joints, {r(at('nose') + '.x', 'nose_x')} FROM good")
def arr06(spark, sf):
    m = pose.by_name(pose.valid(F.col("k"), 0.35))
    return _poses(spark, sf).select("vec_id", m.alias("m")).select("vec_id", F.size("m").cast("bigint").alias("joints"), F.try_element_at("m", F.lit("nose"))["x"].alias("nose_x")).select("vec_id", "joints", _r("nose_x"))


@query("arr09_pose_candidates", POSES + f""", f AS (SELECT vec_id, g, list_filter(g, lambda p: p.name IN ('left_ankle', 'right_ankle')) AS a FROM good) SELECT vec_id, {r('list_avg(list_transform(a, lambda p: p.x))', 'foot_x')}, {r('list_avg(list_transform(a, lambda p: p.y))', 'foot_y')}, {r('list_avg(list_transform(g, lambda p: p.confidence))', 'score')}
FROM f WHERE len(g) >= 6 AND len(a) > 0 AND list_avg(list_transform(a, lambda p: p.x)) >= 0""")
def arr09(spark, sf):
    d = _poses(spark, sf).select("vec_id", pose.candidate(F.col("k"), 0.35, 6).alias("c")).where("c is not null and c.foot_x >= 0")  # the mask: the right half
    return d.select("vec_id", "c.*").select("vec_id", _r("foot_x"), _r("foot_y"), _r("score"))


@query("arr13_clean_values", CELLS + " SELECT event_id, CASE WHEN event_id % 8 IN (2, 6) THEN '{\"a\":null,\"b\":[1.0,null]}' ELSE '{\"a\":' || CAST(event_id % 8 AS VARCHAR) || '.5,\"b\":[1.0,null]}' END AS cell FROM c")
def arr13(spark, sf):
    n = F.col("event_id") % 8
    value = F.when(n == 2, float("nan")).when(n == 6, float("-inf")).otherwise(n + 0.5)
    return _cells(spark, sf).select("event_id", F.to_json(coerce.clean_struct(F.struct(value.alias("a"), F.array(F.lit(1.0), F.lit(float("inf"))).alias("b")), "struct<a:double,b:array<double>>"), {"ignoreNullFields": "false"}).alias("cell"))


@query("prx1_proximity", POSES + f""", w AS (SELECT vec_id, list_min(list_transform(list_filter(g, lambda p: p.name IN ('left_wrist', 'right_wrist')), lambda p: sqrt((10 - p.x) ** 2 + (5 - p.y) ** 2) / 40)) AS d FROM good)
SELECT vec_id, {r('least(1, greatest(0, 1 - coalesce(d, sqrt(8.0::DOUBLE) / 40) / 0.75::DOUBLE))', 'proximity')} FROM w""")
def prx1(spark, sf):
    p = pose.proximity(pose.valid(F.col("k"), 0.35), F.lit(40.0), (F.lit(10.0), F.lit(5.0)), (F.lit(12.0), F.lit(7.0)), 0.75)
    return _poses(spark, sf).select("vec_id", p.alias("proximity")).select("vec_id", _r("proximity"))


@query("sup13_wrist_of_torso", POSES + LEAN + f" SELECT vec_id, {r('(' + at('left_wrist') + '.x - coalesce((sx + hx) / 2, sx, hx)) / 50', 'x')} FROM m")
def sup13(spark, sf):
    x, _ = pose.relative_wrist(F.col("g"), "left", F.lit(50.0))
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", x.alias("x")).select("vec_id", _r("x"))


@query("sup14_wrist_of_whole_torso", POSES + LEAN + f" SELECT vec_id, {r('(' + at('left_wrist') + '.x - (sx + hx) / 2) / 50', 'x')}, {r('(' + at('left_wrist') + '.y - (sy + hy) / 2) / 50', 'y')} FROM m")
def sup14(spark, sf):
    x, y = pose.relative_wrist(F.col("g"), "left", F.lit(50.0), whole_torso=True)
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", x.alias("x"), y.alias("y")).select("vec_id", _r("x"), _r("y"))


@query("sup15_joint_angle", POSES + f", v AS (SELECT vec_id, {at('left_hip')} AS a, {at('left_knee')} AS b, {at('left_ankle')} AS c FROM good) SELECT vec_id, round(degrees(acos(greatest(-1, least(1, ((a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y)) / nullif(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2), 0))))), 3) AS angle FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def sup15(spark, sf):
    p = [(pose.point(F.col("g"), n)["x"], pose.point(F.col("g"), n)["y"]) for n in ("left_hip", "left_knee", "left_ankle")]
    return _poses(spark, sf).withColumn("g", pose.valid(F.col("k"), 0.35)).select("vec_id", F.round(g.vertex_angle(*p), 3).alias("angle")).where("angle is not null")


# ---- calibration tables

@query("cal09_representative_frames", "WITH n AS (SELECT o_orderkey, o_custkey % 12 AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 0 THEN '0' ELSE array_to_string(list_reduce(list_concat([[]::BIGINT[]], list_transform([50, 35, 65, 20, 80], lambda p: [(n * p) // 100])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ',') END AS frames FROM n")
def cal09(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", F.array_join(scores.representative_frames(F.col("o_custkey") % 12), ",").alias("frames"))


@query("cal12_layout_score", BOXES + f", p AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS n, x1 > 20 AS split, y1 / 100 AS big FROM b) SELECT l_orderkey, l_linenumber, {r('CASE WHEN n = 0 THEN 0.15::DOUBLE ELSE (CASE WHEN n BETWEEN 2 AND 5 AND split THEN 1 WHEN n BETWEEN 2 AND 6 THEN 0.68::DOUBLE WHEN n = 1 THEN 0.42::DOUBLE ELSE 0.52::DOUBLE END) * CASE WHEN big > 0.10::DOUBLE THEN 0.5::DOUBLE ELSE 1 END END', 'score')} FROM p")
def cal12(spark, sf):
    s = scores.layout_score(F.col("l_linenumber") - 1, F.col("x1") > 20, F.col("y1") / 100)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", s.alias("score")).select("l_orderkey", "l_linenumber", _r("score"))


SEGMENTS = BOXES + ", s AS (SELECT l_orderkey, l_linenumber, (degrees(atan2(v1 - y1, u1 - x1)) + 360) % 180 AS angle, sqrt((u1 - x1) ** 2 + (v1 - y1) ** 2) AS length, (x1 + u1) / 2 AS mx, (y1 + v1) / 2 AS my FROM b)"


def _segments(spark, sf):
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", g.segment_features(F.col("x1"), F.col("y1"), F.col("u1"), F.col("v1")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("sup48_segment_features", SEGMENTS + f" SELECT l_orderkey, l_linenumber, round(angle, 4) % 180 AS angle, {r('length')}, {r('mx')}, {r('my')} FROM s")
def sup48(spark, sf):
    return _segments(spark, sf).select("l_orderkey", "l_linenumber", (F.round("angle", 4) % 180).alias("angle"), _r("length"), _r("mx"), _r("my"))


@query("sup49_segment_classes", SEGMENTS + " SELECT l_orderkey, l_linenumber, CASE WHEN angle <= 20 OR angle >= 160 THEN 'across' WHEN angle BETWEEN 45 AND 135 THEN 'along' END AS side FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, side ORDER BY length DESC, l_linenumber) <= 2 AND side IS NOT NULL")
def sup49(spark, sf):
    from ..operators import tracking

    d = _segments(spark, sf).withColumn("side", g.segment_class(F.col("angle"))).where("side is not null")
    return tracking.longest_segments(d, ["l_orderkey", "side"], 2, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "side")


@query("sup50_corner_text", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 3 THEN 8 END AS numbers, CASE o_orderkey % 4 WHEN 0 THEN -1.5::DOUBLE WHEN 3 THEN 0.1::DOUBLE END AS first FROM orders")
def sup50(spark, sf):
    n = F.col("o_orderkey") % 4
    text = F.when(n == 0, "-1.5,0; 1,0 ;1,1;0,1").when(n == 1, "0,0;1,0;1,1").when(n == 2, "0,0;4,0;1,1;0,1").otherwise("0.1,0.1;0.9,0.1;0.9,0.9;0.1,0.9")
    c = coerce.corner_text(text)
    return views.table(spark, sf, "orders").select("o_orderkey", F.when(c.isNotNull(), F.size(F.flatten(c))).alias("numbers"), F.get(F.get(c, F.lit(0)), F.lit(0)).alias("first"))


# ---- association: scores of its own

TRK1 = BOXES + ", p AS (SELECT l_orderkey, l_linenumber, x1 + 5 AS fx, y2 + 30 AS fy, u1 * 200 AS area, v1 / 17 AS c, y2 + 30 - 60 AS d, u1 AS ex, v1 + 40 AS ey FROM b), s AS (SELECT *, sqrt((fx - ex) ** 2 + (fy - ey) ** 2) AS away FROM p)"


@query("trk01_role_scores", TRK1 + f""" SELECT l_orderkey, l_linenumber, {r('''c * 120 + CASE WHEN d >= 0 THEN least(35, d * 0.22::DOUBLE) ELSE d * 4.2::DOUBLE END + least(18, area / 1200) - away * 0.35::DOUBLE + 0.4::DOUBLE * 50 + greatest(0, 40 - greatest(0, -d)) * 0.18::DOUBLE''', 'near', 4)},
  {r('''c * 120 + CASE WHEN d <= 0 THEN least(30, -d * 0.22::DOUBLE) ELSE -d * 4.2::DOUBLE END - abs(area - 5000) / 1400 - away * 0.22::DOUBLE + 0.4::DOUBLE * 50 + greatest(0, 40 - greatest(0, d)) * 0.18::DOUBLE''', 'far', 4)} FROM s""")
def trk01(spark, sf):
    c = F.col
    one = lambda role: scores.role_score(role, c("v1") / 17, (c("x1") + 5, c("y2") + 30), c("u1") * 200, 60.0, 40.0, (c("u1"), c("v1") + 40), F.lit(0.4))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", one("near").alias("near"), one("far").alias("far")).select("l_orderkey", "l_linenumber", _r("near", 4), _r("far", 4))


@query("trk02_prediction", BOXES + f" SELECT l_orderkey, l_linenumber, {r('x1 + u1 * greatest(0.25::DOUBLE, 0.82::DOUBLE ** l_linenumber)', 'x')} FROM b")
def trk02(spark, sf):
    x = scores.carried(F.col("x1"), F.col("u1"), F.col("l_linenumber"))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", _r("x"))
