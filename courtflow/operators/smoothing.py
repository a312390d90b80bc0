"""Trajectory cleaning: gap-limited interpolation, run-scoped medians, resettable exponential smoothing.

Rows of a track share the key columns and are ordered by an integer frame. Everything partitions by the key, so a
track is the unit of work and tracks run in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_frame(keys: list[str], frame: str = "frame_id"):
    return Window.partitionBy(*keys).orderBy(frame)


def islands(df: DataFrame, keys: list[str], breaks: Column, name: str, frame: str = "frame_id") -> DataFrame:
    """df with a number more that goes up at each row of a key at which `breaks` holds."""
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(by_frame(keys, frame).rowsBetween(Window.unboundedPreceding, 0)))


def duplicate_frames(df: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Keys and frames that occur more than once, which the windows below don't allow; with their count."""
    return df.groupBy(*keys, frame).agg(F.count("*").alias("rows")).where("rows > 1")


def row_is_valid(coordinates: list[str], min_confidence: float, confidence: str = "confidence", visibility: str = "visibility") -> Column:
    """All coordinates there, confidence not below the least (null passes), not invisible."""
    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in coordinates))
    return there & F.coalesce(F.col(confidence) >= min_confidence, F.lit(True)) & F.coalesce(F.col(visibility) != 0, F.lit(True))


def interpolate(df: DataFrame, keys: list[str], columns: list[str], valid: Column, max_gap: int = 4, max_displacement: float | None = None, frame: str = "frame_id") -> DataFrame:
    """df with filled_<c> of each column and is_gap_filled more.

    An invalid row strictly between two valid ones gets the values on the line between them if at most max_gap frames lie
    between (frames without a row count too) and, where max_displacement is given, its ends (the first two columns) are no further apart.
    """
    w = by_frame(keys, frame)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(valid, F.struct(F.col(frame).alias("f"), *(F.col(c).alias(c) for c in columns)))
    a, b = F.col("__a"), F.col("__b")
    out = df.withColumn("__v", valid).withColumn("__a", F.last(point, True).over(before)).withColumn("__b", F.first(point, True).over(after))
    gap = b["f"] - a["f"] - 1
    fills = ~F.col("__v") & (gap > 0) & (gap <= max_gap)
    if max_displacement is not None:
        x, y = columns[:2]
        fills &= F.hypot(b[x] - a[x], b[y] - a[y]) <= max_displacement
    fills = F.coalesce(fills, F.lit(False))
    share = (F.col(frame) - a["f"]) / (b["f"] - a["f"]).cast("double")
    out = out.withColumn("is_gap_filled", F.when(fills, 1).otherwise(0))
    for c in columns:
        out = out.withColumn(f"filled_{c}", F.when(F.col("__v"), F.col(c)).when(F.col("is_gap_filled") == 1, a[c] + (b[c] - a[c]) * share))
    return out.drop("__v", "__a", "__b")


def contiguous_runs(df: DataFrame, keys: list[str], column: str, name: str = "run", frame: str = "frame_id") -> DataFrame:
    """df with the number of each row's run more: runs break at a missing frame and where the column turns null or not null."""
    w = by_frame(keys, frame)
    breaks = (F.col(frame) - F.lag(frame).over(w) != 1) | (F.col(column).isNull() != F.lag(F.col(column).isNull()).over(w))
    return islands(df.withColumn("__break", F.coalesce(breaks, F.lit(True))), keys, F.col("__break"), name, frame).drop("__break")


def rolling_median(df: DataFrame, keys: list[str], column: str, window: int, out: str, run: str = "run", frame: str = "frame_id") -> DataFrame:
    """df with the median of up to window // 2 rows to either side within the row's run more."""
    if window <= 1:
        return df.withColumn(out, F.col(column))
    r = window // 2
    w = Window.partitionBy(*keys, run).orderBy(frame).rowsBetween(-r, r)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.percentile(column, F.lit(0.5)).over(w)))


def exponential(df: DataFrame, keys: list[str], columns: dict[str, str], alpha: float, runs: dict[str, str], frame: str = "frame_id") -> DataFrame:
    """df with exponentially smoothed columns {column: new name} more, restarted at each run.

    A fold, as the state is the value before: over the sorted array of each run, on the JVM.
    """
    out = df
    for c, new in columns.items():
        out = _exponential(out, keys, c, new, alpha, runs[c], frame)
    return out


def _exponential(df: DataFrame, keys: list[str], column: str, new: str, alpha: float, run: str, frame: str) -> DataFrame:
    if alpha <= 0:
        return df.withColumn(new, F.col(column))
    points = df.where(F.col(column).isNotNull()).groupBy(*keys, run).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(column).alias("x")))).alias("p"))
    start = F.struct(F.array().cast("array<struct<f:bigint,s:double>>").alias("out"), F.lit(None).cast("double").alias("s"))

    def fold(a, p):
        s = F.when(a["s"].isNull(), p["x"]).otherwise(F.lit(alpha) * p["x"] + F.lit(1 - alpha) * a["s"])
        return F.struct(F.concat(a["out"], F.array(F.struct(p["f"].cast("bigint").alias("f"), s.alias("s")))).alias("out"), s.alias("s"))

    made = points.select(*keys, F.explode(F.aggregate("p", start, fold, lambda a: a["out"])).alias("q")).select(*keys, F.col("q.f").alias(frame), F.col("q.s").alias(new))
    return df.join(made, [*keys, frame], "left")


def smooth(df: DataFrame, keys: list[str], columns: list[str], min_confidence: float = 0.2, max_gap: int = 4, max_displacement: float | None = None, window: int = 5, alpha: float = 0.35, frame: str = "frame_id") -> DataFrame:
    """df with smoothed_<c> of each column, is_gap_filled and is_smoothed_valid more: interpolated, then by contiguous run median and exponential."""
    out = interpolate(df, keys, columns, row_is_valid(columns, min_confidence), max_gap, max_displacement, frame)
    first = f"filled_{columns[0]}"
    out = contiguous_runs(out, keys, first, "__run", frame)  # a row has all filled columns or none
    for c in columns:
        out = rolling_median(out, keys, f"filled_{c}", window, f"__median_{c}", "__run", frame)
    out = exponential(out, keys, {f"__median_{c}": f"smoothed_{c}" for c in columns}, alpha, {f"__median_{c}": "__run" for c in columns}, frame)
    there = reduce(lambda a, b: a | b, (F.col(f"smoothed_{c}").isNotNull() for c in columns))
    return out.withColumn("is_smoothed_valid", F.when(there, 1).otherwise(0)).drop("__run", *(f"__median_{c}" for c in columns), *(f"filled_{c}" for c in columns))


def smoothing_summary(smoothed: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    return smoothed.groupBy(*keys).agg(
        F.count("*").alias("total_rows"), F.sum(F.when(valid, 1).otherwise(0)).alias("source_valid_rows"),
        F.sum("is_gap_filled").alias("gap_filled_rows"), F.sum("is_smoothed_valid").alias("smoothed_valid_rows"),
    )


def trail(df: DataFrame, keys: list[str], valid: Column, point: Column, length: int, out: str = "trail", frame: str = "frame_id") -> DataFrame:
    """df with the last `length` points up to each row more; an invalid row empties the trail."""
    broken = islands(df.withColumn("__v", valid), keys, ~F.col("__v"), "__i", frame)
    w = Window.partitionBy(*keys, "__i").orderBy(frame).rowsBetween(-(length - 1), 0)
    return broken.withColumn(out, F.collect_list(F.when(F.col("__v"), point)).over(w)).drop("__v", "__i")
