"""Stroke candidates and what they rest on: reversals, turn and proximity evidence, temporal suppression, phases, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .smoothing import by_frame, islands


def reversals(track: DataFrame, keys: list[str], min_angle: float, x: str = "x", y: str = "y", frame: str = "frame_id") -> DataFrame:
    """Rows whose direction turns by more than min_angle degrees between the frame before and the one after, with the angle."""
    w = by_frame(keys, frame)
    prev, nxt = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    cosine = g.cosine_between(F.col(x) - prev(x), F.col(y) - prev(y), nxt(x) - F.col(x), nxt(y) - F.col(y), 1e-6)
    near = (F.col(frame) - prev(frame) == 1) & (nxt(frame) - F.col(frame) == 1)
    turned = track.withColumn("__cos", F.when(near, cosine)).where(F.degrees(F.acos("__cos")) > min_angle - 1e-9)  # a few more than turn, if any
    return turned.withColumn("angle", F.degrees(g.acos_as_sql(F.col("__cos")))).where(F.col("angle") > min_angle).drop("__cos")


def _apart(rows: DataFrame, keys: list[str], gap: int, frame: str) -> DataFrame:
    """rows with __part more: parts of a key with more than `gap` frames between them, which no fold below reaches across."""
    far = F.coalesce(F.col(frame) - F.lag(frame).over(by_frame(keys, frame)) > gap, F.lit(False))
    return islands(rows.withColumn("__far", far), keys, F.col("__far"), "__part", frame).drop("__far")


def merge_turns(turns: DataFrame, keys: list[str], merge_frames: int, frame: str = "frame_id") -> DataFrame:
    """(keys, frame, angle): of turns within merge_frames of the last kept one the sharper stays, and the anchor moves with it.

    The anchor depends on what was kept, so this is a fold over sorted turns, on the JVM, of one run of near turns at a time.
    """
    kind = "array<struct<f:bigint,a:double>>"
    parts = _apart(turns, keys, merge_frames, frame)
    rows = parts.groupBy(*keys, "__part").agg(F.array_sort(F.collect_list(F.struct(F.col(frame).cast("bigint").alias("f"), F.col("angle").alias("a")))).cast(kind).alias("t"))

    def fold(kept, t):
        last = F.get(kept, F.size(kept) - 1)
        near = (F.size(kept) > 0) & (t["f"] - last["f"] <= merge_frames)
        return F.when(near & (t["a"] > last["a"]), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(t))).when(near, kept).otherwise(F.concat(kept, F.array(t)))

    return rows.select(*keys, F.explode(F.aggregate("t", F.array().cast(kind), fold)).alias("e")).select(*keys, F.col("e.f").alias(frame), F.col("e.a").alias("angle"))


def turn_evidence(track: DataFrame, keys: list[str], turn_deg: float = 45.0, span: int = 3, x: str = "x", y: str = "y", frame: str = "frame_id") -> DataFrame:
    """track with turn_angle and turn_score more, over min(span, rows to either end) observations, each side at most two frames a row."""
    w, whole = by_frame(keys, frame), Window.partitionBy(*keys)
    d = track.withColumns({"__n": F.count("*").over(whole), "__i": F.row_number().over(w) - 1})
    d = d.withColumn("__k", F.least(F.lit(span), F.col("__i"), F.col("__n") - F.col("__i") - 1))
    pick = lambda f, c: F.coalesce(*(F.when(F.col("__k") == k, f(c, k).over(w)) for k in range(1, span + 1)))
    names = {f"__{s}{c}": pick(f, c) for s, f in (("p", F.lag), ("q", F.lead)) for c in (x, y, frame)}
    d = d.withColumns(names)
    col = lambda s, c: F.col(f"__{s}{c}")
    near = (F.col(frame) - col("p", frame) <= 2 * F.col("__k")) & (col("q", frame) - F.col(frame) <= 2 * F.col("__k"))
    angle = g.angle_between(F.col(x) - col("p", x), F.col(y) - col("p", y), col("q", x) - F.col(x), col("q", y) - F.col(y))
    d = d.withColumn("turn_angle", F.when(near, angle)).withColumn("turn_score", F.coalesce(g.clamp(F.col("turn_angle") / turn_deg, 0, 1), F.lit(0.0)))
    return d.drop("__n", "__i", "__k", *names)


def proximity_score(ratio: Column, reach: float = 0.75) -> Column:
    """1 at no distance, 0 from `reach` body heights on; null distances give 0."""
    return F.coalesce(g.clamp(1 - ratio / reach, 0, 1), F.lit(0.0))


def candidate_score(turn: Column, near: Column, wrist: Column) -> Column:
    return 0.45 * turn + 0.35 * near + 0.20 * wrist


def temporal_nms(candidates: DataFrame, keys: list[str], min_gap: int, score: str = "score", frame: str = "frame_id") -> DataFrame:
    """candidates less those within min_gap frames of a better one that stays; better: higher score, then earlier frame.

    What stays depends on what stayed, so this is a fold on the JVM, of one run of near candidates at a time.
    """
    kind = "array<struct<s:double,f:bigint>>"
    parts = _apart(candidates, keys, min_gap - 1, frame)
    rows = parts.groupBy(*keys, "__part").agg(F.array_sort(F.collect_set(F.struct((-F.col(score)).alias("s"), F.col(frame).cast("bigint").alias("f")))).cast(kind).alias("c"))
    fold = lambda kept, c: F.when(F.exists(kept, lambda o: F.abs(o["f"] - c["f"]) < min_gap), kept).otherwise(F.concat(kept, F.array(c)))
    stays = rows.select(*keys, F.explode(F.aggregate("c", F.array().cast(kind), fold)).alias("e")).select(*keys, F.col("e.f").alias(frame), (-F.col("e.s")).alias(score))
    return candidates.join(stays, [*keys, frame, score])


def nearest_player(events: DataFrame, players: DataFrame, keys: list[str], max_distance: float, x: str = "x", y: str = "y", frame: str = "frame_id", player: str = "player_id") -> DataFrame:
    """Each event with the nearest player of its frame, nearer than max_distance; of equals the least id."""
    pairs = events.join(players.select(*keys, frame, player, F.col("px"), F.col("py")), [*keys, frame])
    d = g.length(F.col(x) - F.col("px"), F.col(y) - F.col("py"))
    best = pairs.withColumn("distance", d).where(F.col("distance") < max_distance)
    return best.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, frame).orderBy("distance", player))).where("__r = 1").drop("__r", "px", "py")


def numbered(events: DataFrame, keys: list[str], rally: str, frame: str = "frame_id") -> DataFrame:
    n = F.row_number().over(by_frame(keys, frame))
    return events.withColumn("event_id", F.concat(F.col(rally), F.format_string("_E%03d", n)))


def longest_run(df: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """(keys, longest_run): the most frames in a row."""
    d = df.select(*keys, frame).distinct()
    island = d.withColumn("__i", F.col(frame) - F.row_number().over(by_frame(keys, frame)))
    return island.groupBy(*keys, "__i").count().groupBy(*keys).agg(F.max("count").alias("longest_run"))


def range_median(df: DataFrame, keys: list[str], column: str, radius: int, out: str, frame: str = "frame_id") -> DataFrame:
    """df with the median over rows of at most `radius` frames to either side more."""
    return df.withColumn(out, F.percentile(column, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(frame).rangeBetween(-radius, radius)))


def phases(signal: DataFrame, events: DataFrame, keys: list[str], min_contiguous: int = 5, radius: int = 2, share: float = 0.35) -> DataFrame:
    """Five half-open intervals of a swing from a speed signal in the event's window, or one row with the reason why not.

    signal: keys, frame_id, speed (null at a row without one). events: keys, event_id, candidate_frame, window_start_frame, window_end_frame.
    """
    own = [*keys, "event_id"]
    c, frame = F.col("candidate_frame"), F.col("frame_id")
    inside = [events[k] == signal[k] for k in keys] + [signal["frame_id"] >= events["window_start_frame"], signal["frame_id"] < events["window_end_frame"]]
    rows = events.join(signal, inside, "left").select(*(events[k] for k in keys), "event_id", "candidate_frame", "frame_id", "speed")
    # all windows below part by the event, so one shuffle serves them and the final aggregate
    whole, w = Window.partitionBy(*own), by_frame(own)
    d = rows.withColumn("v", F.when(F.col("speed").isNotNull(), F.percentile("speed", F.lit(0.5)).over(w.rangeBetween(-radius, radius))))
    d = d.withColumns({"peak": F.max("v").over(whole), "a": F.min("frame_id").over(whole), "b": F.max("frame_id").over(whole) + 1, "__i": frame - F.row_number().over(w), "__nf": F.lead("frame_id").over(w), "__nv": F.lead("v").over(w)})
    d = d.withColumns({"limit": F.col("peak") * share, "c0": F.greatest(F.col("a") + 1, c - 1), "c1": F.least(F.col("b") - 1, c + 2), "__run": F.count("frame_id").over(Window.partitionBy(*own, "__i"))})
    calm = (frame >= F.col("c1")) & (F.col("__nf") == frame + 1) & (F.col("v") < F.col("limit")) & (F.col("__nv") < F.col("limit"))
    each = d.groupBy(*own, "candidate_frame", "peak", "a", "b", "c0", "c1").agg(
        F.max("__run").alias("longest_run"), F.count("speed").alias("moves"), F.min(F.when((frame < c) & (F.col("v") >= F.col("limit")), frame)).alias("onset"), F.min(F.when(calm, frame)).alias("decay")
    )
    reason = (
        F.when(F.coalesce("longest_run", F.lit(0)) < min_contiguous, "insufficient_contiguous_pose").when((c - F.col("a") < 2) | (F.col("b") - c < 3), "truncated_event_window")
        .when(F.coalesce("moves", F.lit(0)) < min_contiguous - 1, "insufficient_wrist_motion").when(F.col("peak") <= 1e-9, "no_motion_peak").when(F.col("onset").isNull(), "no_acceleration_onset")
    )
    rest = F.greatest(F.col("c1") + 1, F.coalesce("decay", "b"))
    each = each.withColumn("phase_reject_reason", reason).withColumns({"onset": F.least(F.col("onset"), F.col("c0") - 1), "rest": F.least(rest, F.col("b"))})
    part = lambda n, name, s, e: F.struct(F.lit(n).alias("n"), F.lit(name).alias("phase"), F.col(s).alias("start_frame"), F.col(e).alias("end_frame"))
    parts = F.array(part(1, "preparation", "a", "onset"), part(2, "acceleration", "onset", "c0"), part(3, "contact_window", "c0", "c1"), part(4, "follow_through", "c1", "rest"), part(5, "recovery", "rest", "b"))
    kept = F.when(F.col("phase_reject_reason").isNull(), F.filter(parts, lambda p: p["end_frame"] > p["start_frame"]))
    out = each.select(*own, "phase_reject_reason", F.posexplode_outer(kept).alias("i", "p"))
    return out.select(*own, "p.phase", (F.col("i") + 1).cast("bigint").alias("phase_order"), "p.start_frame", "p.end_frame", F.when(F.col("phase_reject_reason").isNull(), "eligible").otherwise("not_eligible").alias("phase_eligibility"), "phase_reject_reason")


def event_eligibility(rows: DataFrame, keys: list[str], mode: Column, player: str = "player_id") -> DataFrame:
    """(keys, mode, eligibility, reason): events need tracks of both players; auto resolves by what there is. Where rows of a key differ in mode, the least holds."""
    roles = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(player)).alias("roles"), F.min(mode).alias("asked"))
    both = F.array_contains("roles", "near") & F.array_contains("roles", "far")
    out = roles.withColumn("mode", F.when(F.col("asked") != "auto", F.col("asked")).when(both, "experimental_two_player").otherwise("near_only"))
    reason = F.when(F.col("mode") == "near_only", "near_only_analysis_does_not_support_hit_or_landing_events").when(~both, "event_analysis_requires_near_and_far_player_tracks").otherwise("")
    return out.withColumn("reason", reason).select(*keys, "mode", F.when(F.col("reason") == "", "experimental").otherwise("not_eligible").alias("eligibility"), "reason")
