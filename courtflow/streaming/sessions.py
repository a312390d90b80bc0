"""Streams: a frame at a time with state, and windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hysteresis_stream(frames: DataFrame, key: str = "k", frame: str = "frame_id", flag: str = "flag", hold: int = 5) -> DataFrame:
    """(key, frame, is_open, session) of a stream of frames: what operators.segments.hysteresis gives for a batch.

    State of a key: whether it is open, sessions so far, the flag's last value and for how long it has held. Frames of a key
    must come in order from batch to batch; within a batch they are sorted.
    """
    kind = dict(frames.dtypes)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, session, last, held = state.get if state.exists else (False, 0, False, 0)
        rows = pd.concat(parts).sort_values(frame)
        out = []
        for f, now in zip(rows[frame], rows[flag]):
            held, last = (held + 1 if held and now == last else 1), bool(now)
            if held == hold and last != is_open:
                is_open, session = last, session + last
            out.append((keys[0], f, is_open, session))
        state.update((is_open, session, last, held))
        yield pd.DataFrame(out, columns=[key, frame, "is_open", "session"])

    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {frame} {kind[frame]}, is_open boolean, session bigint", "is_open boolean, session bigint, last boolean, held bigint", "append", GroupStateTimeout.NoTimeout
    )


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(key, start, end, events) of runs of events less than `gap` apart; a session is given out when the watermark has passed it."""
    s = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def tumbling_stats(events: DataFrame, key: str, value: str, window: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(key, start, rows, mean, most) by windows of fixed length; late rows within the delay still count."""
    s = events.withWatermark(time, delay).groupBy(key, F.window(time, window).alias("w")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return s.select(key, F.col("w.start").alias("start"), "rows", "mean", "most")


def every_nth(frames: DataFrame, n: int, frame: str = "frame_id") -> DataFrame:
    return frames.where(F.col(frame) % n == 0)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in memory (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
