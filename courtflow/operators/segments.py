"""Intervals out of sampled flags: gaps and islands, context padding, merging, hysteresis, interval joins. Intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .smoothing import by_frame, islands


def segments(samples: DataFrame, keys: list[str], flag: Column, step: int, max_gap_frames: int, min_frames: int, averages: dict[str, str], frame: str = "frame_id") -> DataFrame:
    """(keys, segment_id, start_frame, end_frame, frame_count, averages): runs of flagged samples at most max_gap_frames + step apart, not shorter than min_frames, numbered by start."""
    kept = samples.where(flag)
    gap = F.col(frame) - F.lag(frame).over(by_frame(keys, frame))
    runs = islands(kept.withColumn("__gap", gap), keys, F.col("__gap") > max_gap_frames + step, "__i", frame)
    made = runs.groupBy(*keys, "__i").agg(
        F.greatest(F.min(frame), F.lit(0)).alias("start_frame"), (F.max(frame) + step).alias("end_frame"), F.count("*").alias("frame_count"), *(F.avg(c).alias(n) for c, n in averages.items())
    )
    long = made.where(F.col("end_frame") - F.col("start_frame") >= min_frames)
    return long.withColumn("segment_id", F.format_string("%03d", F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame")))).drop("__i")


def rejected_runs(samples: DataFrame, keys: list[str], rejected: Column, step: int, reason: str, score: str, frame: str = "frame_id") -> DataFrame:
    """Runs of consecutive rejected samples with the most frequent reason (of equals the least; low_main_view_score without any)."""
    runs = islands(samples.withColumn("__r", rejected), keys, ~F.col("__r"), "__i", frame).where("__r")
    counts = runs.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(*keys, "__i", reason).count()
    modes = counts.groupBy(*keys, "__i").agg(F.min(F.struct(-F.col("count"), F.col(reason).alias("reason"))).alias("m")).select(*keys, "__i", F.col("m.reason").alias("__mode"))
    made = runs.groupBy(*keys, "__i").agg(F.min(frame).alias("start_frame"), (F.max(frame) + step).alias("end_frame"), F.avg(score).alias("score"))
    named = made.join(modes, [*keys, "__i"], "left").withColumn("reject_reason", F.coalesce("__mode", F.lit("low_main_view_score")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame"))
    return named.withColumn("segment_id", F.format_string("R%03d", number)).drop("__i", "__mode")


def rally_decisions(samples: DataFrame, keys: list[str], active: Column, step: int, max_gap: int, pre: int, post: int, low: int, high: int, min_frames: int, max_frames: int, min_active: int, frame: str = "frame_id") -> DataFrame:
    """Candidates out of active samples, padded by context but not into their neighbours, each accepted or rejected with its reason.

    An end never passes the next group's first frame, so the end of the candidate before is its lag and all groups stay.
    """
    kept = samples.where(active).select(*keys, frame).distinct()
    gap = F.col(frame) - F.lag(frame).over(by_frame(keys, frame)) - step
    runs = islands(kept.withColumn("__gap", gap), keys, F.col("__gap") > max_gap, "__i", frame)
    groups = runs.groupBy(*keys, "__i").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("evidence_count"))
    w = Window.partitionBy(*keys).orderBy("first")
    end = F.least(F.lit(high), F.col("last") + step + post, F.coalesce(F.lead("first").over(w), F.lit(high)))
    ended = groups.withColumn("end_frame", end)
    start = F.greatest(F.lit(low), F.col("first") - pre, F.coalesce(F.lag("end_frame").over(w), F.lit(low)))
    made = ended.withColumn("start_frame", start).where("end_frame > start_frame")
    frames = F.col("end_frame") - F.col("start_frame")
    reason = (
        F.when(F.col("evidence_count") < min_active, "insufficient_active_samples").when(frames < min_frames, "below_min_rally_duration")
        .when(frames > max_frames, "above_max_rally_duration").otherwise("active_play_evidence")
    )
    numbered = made.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "active_play_evidence", "accepted").otherwise("rejected"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame"))
    return numbered.select(*keys, F.format_string("C%03d", number).alias("candidate_id"), "start_frame", "end_frame", "status", "reason", "evidence_count")


def shot_runs(samples: DataFrame, keys: list[str], flag: Column, max_dropped: int, frame: str = "frame_id") -> DataFrame:
    """Runs of flagged samples with at most max_dropped samples without flag between two: (keys, start_frame, end_frame, samples)."""
    numbered = samples.withColumn("__n", F.row_number().over(by_frame(keys, frame))).where(flag)
    dropped = F.col("__n") - F.lag("__n").over(by_frame(keys, frame)) - 1
    runs = islands(numbered.withColumn("__d", dropped), keys, F.col("__d") > max_dropped, "__i", frame)
    return runs.groupBy(*keys, "__i").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("samples")).drop("__i")


def merge_intervals(intervals: DataFrame, keys: list[str], min_length: float, max_gap: float, start: str = "start", end: str = "end", confidence: str = "confidence") -> DataFrame:
    """Intervals not shorter than min_length, in order of start, joined where the gap to the one before is at most max_gap.

    The end of a joined interval is that of its last part, and its confidence the highest.
    """
    long = intervals.where(F.col(end) - F.col(start) >= min_length)
    gap = F.col(start) - F.lag(end).over(by_frame(keys, start))
    runs = islands(long.withColumn("__gap", gap), keys, F.col("__gap") > max_gap, "__i", start)
    return runs.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max_by(end, start).alias(end), F.max(confidence).alias(confidence), F.count("*").alias("parts")).drop("__i")


def gap_split(df: DataFrame, keys: list[str], max_gap: int, min_rows: int, frame: str = "frame_id") -> DataFrame:
    """(keys, part, start_frame, end_frame, rows): tracks split where frames are more than max_gap apart; parts of fewer than min_rows rows go."""
    gap = F.col(frame) - F.lag(frame).over(by_frame(keys, frame))
    runs = islands(df.withColumn("__gap", gap), keys, F.col("__gap") > max_gap, "__i", frame)
    made = runs.groupBy(*keys, "__i").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("rows")).where(F.col("rows") >= min_rows)
    return made.withColumn("part", F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame"))).drop("__i")


def hysteresis(samples: DataFrame, keys: list[str], flag: Column, hold: int = 5, frame: str = "frame_id") -> DataFrame:
    """samples with is_open and session more: the state takes the flag's value once it has held for `hold` samples; sessions count the openings."""
    w = by_frame(keys, frame)
    marked = samples.withColumn("__f", flag)
    runs = islands(marked.withColumn("__c", F.coalesce(F.col("__f") != F.lag("__f").over(w), F.lit(False))), keys, F.col("__c"), "__i", frame)
    place = F.row_number().over(Window.partitionBy(*keys, "__i").orderBy(frame))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = runs.withColumn("__p", place).withColumn("is_open", F.coalesce(F.last(F.when(F.col("__p") == hold, F.col("__f")), True).over(upto), F.lit(False)))
    opens = F.col("is_open") & ~F.coalesce(F.lag("is_open").over(w), F.lit(False))
    return islands(state.withColumn("__o", opens), keys, F.col("__o"), "session", frame).drop("__f", "__c", "__i", "__p", "__o")


def within_intervals(samples: DataFrame, intervals: DataFrame, keys: list[str], frame: str = "frame_id", start: str = "start_frame", end: str = "end_frame", bucket: int = 256) -> DataFrame:
    """samples joined to each interval [start, end) of their key that holds them.

    Both sides also meet on buckets of frames, which an interval has a copy for each of, so the join's work follows its result and not
    samples x intervals of a long video.
    """
    cut = intervals.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    dealt = samples.withColumn("__b", F.floor(F.col(frame) / bucket))
    return dealt.join(cut, [*keys, "__b"]).where((F.col(frame) >= F.col(start)) & (F.col(frame) < F.col(end))).drop("__b")


def latest_before(changes: DataFrame, intervals: DataFrame, keys: list[str], slack: int, max_lag: int, frame: str = "frame_id") -> DataFrame:
    """For each change the latest interval that began by then, ends at most `slack` after it and ended at most max_lag before it; consecutive repeats go."""
    reach = intervals.select(*keys, "start_frame", "end_frame", F.greatest(F.col("start_frame"), F.col("end_frame") - slack).alias("__from"), (F.col("end_frame") + max_lag + 1).alias("__to"))
    near = within_intervals(changes, reach, keys, frame, "__from", "__to")
    best = near.groupBy(*keys, frame).agg(F.max(F.struct("end_frame", "start_frame")).alias("i")).select(*keys, frame, F.col("i.start_frame").alias("start_frame"), F.col("i.end_frame").alias("end_frame"))
    w = by_frame(keys, frame)
    again = (F.lag("start_frame").over(w) == F.col("start_frame")) & (F.lag("end_frame").over(w) == F.col("end_frame"))
    return best.withColumn("__again", F.coalesce(again, F.lit(False))).where("not __again").drop("__again")


def frame_index(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clean_frame_id, original_frame_id): the frames of all intervals of a key, numbered from 0 without gaps."""
    frames = intervals.select(*keys, "start_frame", F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)).alias("original_frame_id"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame", "original_frame_id")) - 1
    return frames.select(*keys, n.cast("bigint").alias("clean_frame_id"), "original_frame_id")


def with_times(intervals: DataFrame, fps: float) -> DataFrame:
    """intervals with start_time, end_time and duration_seconds more, by frames of a constant rate, to the millisecond."""
    at = lambda c: F.round(c / fps, 3)
    return intervals.withColumns({"start_time": at(F.col("start_frame")), "end_time": at(F.col("end_frame")), "duration_seconds": at(F.col("end_frame") - F.col("start_frame"))})
