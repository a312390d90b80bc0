"""Operators on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from courtflow.functions import coerce, pose
from courtflow.functions import geometry as g
from courtflow.operators import evaluation, events, metadata, movement, segments, smoothing, tracking


def track(spark, points, confidence=0.9):
    return spark.createDataFrame([("r", f, f / 10, x, y, confidence, 1) for f, x, y in points], "k string, frame_id bigint, timestamp double, x double, y double, confidence double, visibility int")


def smooth(df, **kw):
    d = smoothing.smooth(df, ["k"], ["x", "y"], **{"max_gap": 2, "window": 1, "alpha": 1.0, **kw})
    return {r["frame_id"]: r for r in d.collect()}


def test_short_gaps_fill_and_long_ones_do_not(spark):
    got = smooth(track(spark, [(0, 0.0, 0.0), (1, None, None), (2, 2.0, 2.0)]))
    assert got[1]["smoothed_x"] == 1.0 and got[1]["is_gap_filled"] == 1 and got[1]["is_smoothed_valid"] == 1
    got = smooth(track(spark, [(0, 0.0, 0.0), (1, None, None), (2, None, None), (3, None, None), (4, 4.0, 4.0)]))
    assert [got[f]["smoothed_x"] for f in range(5)] == [0.0, None, None, None, 4.0] and got[2]["is_gap_filled"] == 0


def test_jumps_are_not_bridged(spark):
    got = smooth(track(spark, [(0, 100.0, 10.0), (1, None, None), (2, 500.0, 12.0)]), max_displacement=80.0)
    assert got[1]["smoothed_x"] is None and got[1]["is_gap_filled"] == 0


def test_missing_frames_reset_the_filter(spark):
    got = smooth(track(spark, [(10, 100.0, 100.0), (0, 0.0, 0.0)]), alpha=0.35, window=5)
    assert got[0]["smoothed_x"] == 0.0 and got[10]["smoothed_x"] == 100.0


def test_exponential_fold(spark):
    got = smooth(track(spark, [(0, 1.0, 0.0), (1, 2.0, 0.0), (2, 3.0, 0.0)]), alpha=0.35)
    assert got[2]["smoothed_x"] == pytest.approx(1.9274999999999998)


def players(spark, rows, role="near"):
    return spark.createDataFrame([("1", role, f, t, x, y) for f, t, x, y in rows], "rally_id string, player_id string, frame_id bigint, timestamp double, court_x double, court_y double")


def test_movement(spark):
    (r,) = movement.movement_summary(players(spark, [(0, 0.0, 3.0, 10.0), (1, 0.1, 3.1, 10.0), (4, 0.4, 5.0, 10.0), (5, 0.5, 5.1, 10.0), (6, 0.6, 3.0, 2.0)])).collect()
    assert (r["frames_valid"], r["rejected_position_rows"], r["distance_steps"], r["discontinuity_count"]) == (4, 1, 2, 1)
    assert r["total_distance_m"] == pytest.approx(0.2) and r["avg_speed_m_s"] == pytest.approx(1.0) and r["movement_eligibility"] == "eligible"
    (r,) = movement.movement_summary(players(spark, [(0, 0.0, 3.0, 10.0), (4, 0.4, 3.0, 10.0)])).collect()
    assert r["movement_eligibility"] == "not_eligible" and r["total_distance_m"] is None and r["avg_speed_m_s"] is None


def test_hull(spark):
    r = random.Random(1)

    def brute(points):
        points = sorted(set(points))
        chain = lambda ps: [h for h in [[]] for p in ps for _ in [push(h, p)]][-1] if ps else []

        def push(h, p):
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)

        low, high = chain(points), chain(points[::-1])
        c = low[:-1] + high[:-1]
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:] + c[:1]))) / 2

    sets = [[(float(r.randrange(6)), float(r.randrange(6))) for _ in range(n)] for n in (1, 2, 3, 4, 9, 30, 200)] + [[(1.0, 1.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]
    df = spark.createDataFrame([(i, [tuple(p) for p in s]) for i, s in enumerate(sets)], "i int, p array<struct<x:double,y:double>>")
    got = {x["i"]: x["a"] for x in df.select("i", g.shoelace(g.convex_hull(F.col("p"))).alias("a")).collect()}
    for i, s in enumerate(sets):
        assert got[i] == pytest.approx(brute(s) if len(set(s)) > 2 else 0.0)


def test_reversals(spark):
    found = events.reversals(track(spark, [(0, 90.0, 100.0), (1, 100.0, 100.0), (2, 90.0, 100.0)]), ["k"], 90.0).collect()
    assert [(r["frame_id"], r["angle"]) for r in found] == [(1, 180.0)]
    assert events.reversals(track(spark, [(0, 90.0, 100.0), (2, 100.0, 100.0), (3, 90.0, 100.0)]), ["k"], 90.0).count() == 0


def test_merge_anchor_moves_with_the_sharper_turn(spark):
    df = spark.createDataFrame([("r", 0, 110.0), ("r", 3, 120.0), ("r", 6, 115.0), ("r", 7, 130.0)], "k string, frame_id bigint, angle double")
    assert [(r["frame_id"], r["angle"]) for r in events.merge_turns(df, ["k"], 3).collect()] == [(3, 120.0), (7, 130.0)]


def test_nms(spark):
    df = spark.createDataFrame([("r", 10, 0.9), ("r", 11, 0.9), ("r", 17, 0.95), ("r", 40, 0.1), ("s", 1, 0.5)], "k string, frame_id bigint, score double")
    assert sorted((r["k"], r["frame_id"]) for r in events.temporal_nms(df, ["k"], 8).collect()) == [("r", 17), ("r", 40), ("s", 1)]


def test_eligibility(spark):
    df = spark.createDataFrame([("a", "near", "near_only"), ("b", "near", "experimental_two_player"), ("c", "near", "auto"), ("c", "far", "auto")], "rally_id string, player_id string, mode string")
    got = {r["rally_id"]: (r["mode"], r["eligibility"]) for r in events.event_eligibility(df, ["rally_id"], F.col("mode")).collect()}
    assert got == {"a": ("near_only", "not_eligible"), "b": ("experimental_two_player", "not_eligible"), "c": ("experimental_two_player", "experimental")}


def test_phases(spark):
    speeds = [0.1, 0.1, 0.1, 0.8, 1.0, 1.2, 1.0, 0.9, 0.1, 0.1, 0.1, 0.1]
    signal = spark.createDataFrame([("r", f, s) for f, s in enumerate(speeds)], "k string, frame_id bigint, speed double")
    ev = spark.createDataFrame([("r", "E1", 5, 0, 12), ("r", "E2", 1, 0, 12), ("q", "E3", 5, 0, 12)], "k string, event_id string, candidate_frame bigint, window_start_frame bigint, window_end_frame bigint")
    rows = events.phases(signal, ev, ["k"]).collect()
    one = [(r["phase"], r["start_frame"], r["end_frame"]) for r in sorted((r for r in rows if r["event_id"] == "E1"), key=lambda r: r["phase_order"])]
    assert one == [("preparation", 0, 3), ("acceleration", 3, 4), ("contact_window", 4, 7), ("follow_through", 7, 8), ("recovery", 8, 12)]
    assert {r["event_id"]: r["phase_reject_reason"] for r in rows if r["phase"] is None} == {"E2": "truncated_event_window", "E3": "insufficient_contiguous_pose"}


def test_geometry(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert pick(g.vertex_angle(p(1, 0), p(0, 0), p(0, 1)), g.vertex_angle(p(-1, 0), p(0, 0), p(1, 0)), g.vertex_angle(p(0, 0), p(0, 0), p(1, 0))) == (90.0, 180.0, None)
    h = g.perspective([(0, 0), (10, 0), (12, 8), (-1, 9)], [(0, 0), (6.1, 0), (6.1, 13.4), (0, 13.4)])
    x, y = g.project(h, F.lit(12.0), F.lit(8.0))
    back = g.project(g.inverse(h), x, y)
    assert pick(x, y, *back) == pytest.approx((6.1, 13.4, 12.0, 8.0))
    assert pick(g.clamp(F.lit(None).cast("double"), 0, 1), g.iou(p(0, 0) + p(2, 2), p(1, 1) + p(3, 3))) == (None, pytest.approx(1 / 7))


def test_coercion(spark):
    df = spark.createDataFrame([(" 1.5 ", "TRUE"), ("", None), ("abc", "0"), ("nan", "yes"), ("-inf", "no"), ("1.7", " 1 ")], "c string, b string")
    got = [tuple(r) for r in df.select(coerce.finite("c"), coerce.integer("c"), coerce.integer("c", 7), coerce.truthy("b")).collect()]
    assert got == [(1.5, 1, 1, True), (None, None, 7, False), (None, None, 7, False), (None, None, 7, True), (None, None, 7, False), (1.7, 1, 1, True)]
    names = spark.createDataFrame([("x_rally_012",), ("x",), (None,)], "s string").select(coerce.rally_id("s"), coerce.duration_label(F.lit(3725.0)), coerce.number_label(F.lit(None).cast("double"))).collect()
    assert [tuple(r) for r in names] == [("012", "1 小时 2 分钟", "—"), ("000", "1 小时 2 分钟", "—"), ("000", "1 小时 2 分钟", "—")]
    labels = df.limit(1).select(coerce.duration_label(F.lit(59.9)), coerce.duration_label(F.lit(59.9), approximate=True), coerce.duration_label(F.lit(90.0), approximate=True), coerce.safe_name(F.lit("._??")), coerce.safe_name(F.lit("a b/c.")))
    assert tuple(labels.first()) == ("59 秒", "不足 1 分钟", "约 2 分钟", "event", "a_b_c")


def test_pose_cells(spark):
    good = '[{"name":"left_wrist","x":1.0,"y":2.0,"confidence":0.9}]'
    df = spark.createDataFrame([(good,), ("[{}]",), ("",), (None,), ("7",)], "c string")
    assert [r[0] for r in df.select(F.size(pose.parse(F.col("c")))).collect()] == [1, 0, 0, 0, 0]
    one = df.limit(1).select(pose.same_length(F.sequence(F.lit(1), F.lit(7)), 3, F.lit(0)), pose.same_length(F.array(F.lit(1)), 3, F.lit(0))).first()
    assert one[0] == [1, 4, 7] and one[1] == [1, 0, 0]


def test_intervals(spark):
    iv = spark.createDataFrame([("v", 0.0, 4.0, 0.5), ("v", 5.0, 9.0, 0.9), ("v", 20.0, 22.0, 0.1), ("v", 10.0, 10.5, 1.0)], "k string, start double, end double, confidence double")
    got = sorted((r["start"], r["end"], r["confidence"], r["parts"]) for r in segments.merge_intervals(iv, ["k"], 1.0, 1.0).collect())
    assert got == [(0.0, 9.0, 0.9, 2), (20.0, 22.0, 0.1, 1)]
    flags = spark.createDataFrame([("v", i, i in (3, 4, 5, 9)) for i in range(12)], "k string, frame_id bigint, flag boolean")
    got = {r["frame_id"]: (r["is_open"], r["session"]) for r in segments.hysteresis(flags, ["k"], F.col("flag"), 3).collect()}
    assert got[4] == (False, 0) and got[5] == (True, 1) and got[7] == (True, 1) and got[8] == (False, 1) and got[11] == (False, 1)


def test_greedy_match(spark):
    p = spark.createDataFrame([("v", 1, 10), ("v", 2, 12), ("v", 3, 50)], "k string, id bigint, frame_id bigint")
    q = spark.createDataFrame([("v", 7, 11), ("v", 8, 12), ("v", 9, 80)], "k string, id bigint, frame_id bigint")
    m = evaluation.greedy_match(evaluation.tolerance_pairs(p, q, ["k"], 3), ["k"], 3)
    assert sorted((r["ref_id"], r["pred_id"]) for r in m.collect()) == [(7, 1), (8, 2)]
    d = evaluation.detection_metrics(p, q, m).first()
    assert (d["true_positives"], d["false_positives"], d["false_negatives"], d["precision"]) == (2, 1, 1, pytest.approx(2 / 3))


def test_metadata(spark):
    old = spark.createDataFrame([("a", "T", "2024", "30"), ("a", "", "x", "unknown"), ("b", "T", "2024", "0")], "match_id string, tournament string, year string, fps string")
    got = sorted((r["match_id"], r["error"]) for r in metadata.metadata_errors(old, ["match_id", "tournament"]).collect())
    assert got == [("a", "duplicate match_id"), ("a", "missing tournament"), ("a", "year is not digits"), ("b", "fps is not positive")]
    new = spark.createDataFrame([("b", "N"), ("c", "N")], "match_id string, tournament string")
    assert sorted(r["match_id"] for r in metadata.register(old, new).collect()) == ["a", "a", "b", "c"]


def test_players_are_carried_on_and_ghosts_end(spark):
    boxes = [(f, 100.0 + 5 * f, 400.0, 140.0 + 5 * f, 500.0, 0.9) for f in (0, 1, 2, 5, 6)] + [(f, 300.0, 50.0, 330.0, 120.0, 0.8) for f in range(7)]
    df = spark.createDataFrame([("v", *b) for b in boxes], "video string, frame_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r["frame_id"], r["player_id"]): r for r in tracking.assign_players(df, "video", 300.0).collect()}
    assert got[3, "near"]["is_interpolated"] and got[3, "near"]["x1"] > 110 and not got[5, "near"]["is_interpolated"] and not got[3, "far"]["is_interpolated"]
    assert (got[3, "near"]["confidence"], got[0, "near"]["confidence"]) == (0.16, 0.9)
    gate = tracking.PlayerGate(missing={"near": 1, "far": 1})
    assert (4, "near") not in {(r["frame_id"], r["player_id"]) for r in tracking.assign_players(df, "video", 300.0, gate).collect()}


def test_roles_by_projection_and_overlap(spark):
    """Which side a player is on is told by the court point of the foot; a carried box on another's body ends."""
    schema = "video string, frame_id bigint, x1 double, y1 double, x2 double, y2 double, score double"
    h = [[1, 0, 0], [0, 6.7 / 332.55, 0], [0, 0, 1]]
    df = spark.createDataFrame([("v", 0, 305.0, 294.0, 326.0, 350.0, 0.8), ("v", 0, 380.0, 240.0, 399.0, 281.0, 0.7)], schema)
    got = {r["player_id"]: (r["x1"], r["y2"]) for r in tracking.assign_players(df, "video", 200.0, homography=h).collect()}
    assert got == {"near": (305.0, 350.0), "far": (380.0, 281.0)}
    df = spark.createDataFrame([("v", 0, 305.0, 294.0, 326.0, 350.0, 0.8), ("v", 1, 305.0, 294.0, 326.0, 330.0, 0.7)], schema)
    got = [(r["frame_id"], r["player_id"]) for r in tracking.assign_players(df, "video", 200.0, homography=h).collect()]
    assert got == [(0, "near"), (1, "far")]
    only = tracking.assign_players(df, "video", 200.0, homography=h, roles=("near",)).collect()
    assert [(r["frame_id"], r["player_id"], r["is_interpolated"]) for r in only] == [(0, "near", False), (1, "near", True)]
    # two on one side: the better role score, not the better detection, wins
    two = spark.createDataFrame([("v", 0, 100.0, 400.0, 140.0, 500.0, 0.7), ("v", 0, 300.0, 290.0, 320.0, 305.0, 0.75)], schema)
    assert [r["x1"] for r in tracking.assign_players(two, "video", 300.0).collect()] == [100.0]


def test_outlier_gate_gives_in(spark):
    df = track(spark, [(f, 0.0 if f < 3 else 1000.0, 0.0) for f in range(12)]).select("k", "frame_id", "x", "y")
    kept = {r["frame_id"]: r["is_kept"] for r in tracking.gate_outliers(df, "k", patience=5).collect()}
    assert [f for f in kept if not kept[f]] == [3, 4, 5, 6, 7, 8]


def test_leader_clusters(spark):
    square = lambda d: [[d, d], [100.0 + d, d], [100.0 + d, 50.0 + d], [d, 50.0 + d]]
    rows = [("v", 0, square(0.0), 0.5), ("v", 1, square(1.0), 0.7), ("v", 1, square(0.5), 0.6), ("v", 2, square(60.0), 0.99), ("w", 0, square(0.0), 0.1)]
    df = spark.createDataFrame(rows, "video string, frame_id bigint, corners array<array<double>>, quality double")
    got = sorted((r["video"], r["frame_id"], r["quality"], r["cluster"], r["is_stable"], r["is_chosen"]) for r in tracking.leader_clusters(df, "video", 0.04, 200, 100).collect())
    assert got == [("v", 0, 0.5, 0, True, False), ("v", 1, 0.7, 0, True, True), ("v", 2, 0.99, 1, False, False), ("w", 0, 0.1, 0, True, False)]
