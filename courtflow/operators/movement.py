"""Court movement: steps between positions, distances and speeds by player, roll-ups, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import geometry as g

KEYS = ["rally_id", "player_id"]


def on_own_half(x="court_x", y="court_y", player="player_id") -> Column:
    x, y, player = F.col(x), F.col(y), F.col(player)
    inside = x.between(0, g.WIDTH_M) & y.between(0, g.LENGTH_M)
    return F.coalesce(inside & F.when(player == "near", y >= g.NET_M).otherwise(y <= g.NET_M), F.lit(False))


def in_order(keys: list[str], x: str, y: str, frame: str = "frame_id"):
    """By frame, rows without one last; rows of one frame, as of tracks that share a key, by place, so that the result is determined."""
    return Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in (frame, x, y)))


def steps(points: DataFrame, keys: list[str], x: str, y: str, max_gap: int = 1, max_speed: float | None = 12.0, frame: str = "frame_id", time: str = "timestamp") -> DataFrame:
    """points with frame_gap, time_gap, step (distance) and speed more; step and speed are null unless the step counts: at most max_gap frames and some time on, and not faster than max_speed."""
    w = in_order(keys, x, y, frame)
    d = points.withColumns({"frame_gap": F.col(frame) - F.lag(frame).over(w), "time_gap": F.col(time) - F.lag(time).over(w), "__d": g.length(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))})
    counts = (F.col("frame_gap") > 0) & (F.col("frame_gap") <= max_gap) & (F.col("time_gap") > 0)
    d = d.withColumn("speed", F.when(counts, F.col("__d") / F.col("time_gap")))
    if max_speed is not None:
        d = d.withColumn("speed", F.when(F.col("speed") <= max_speed, F.col("speed")))
    return d.withColumn("step", F.when(F.col("speed").isNotNull(), F.col("__d"))).drop("__d")


def movement_summary(positions: DataFrame, keys: list[str] = KEYS, x: str = "court_x", y: str = "court_y", with_hull: bool = True) -> DataFrame:
    """Of each group with a position on its own half: counts, distance, duration, mean position, zone shares, covered area.

    Distances and speeds are null, not 0, where no step counts.
    """
    seen = positions.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__ok", on_own_half(x, y))
    rejected = seen.groupBy(*keys).agg(F.sum(F.when(F.col("__ok"), 0).otherwise(1)).alias("rejected_position_rows"))
    moved = steps(seen.where("__ok"), keys, x, y).withColumn("__zone", g.zone(g.own_depth(F.col("player_id"), F.col(y))))
    share = lambda z: (F.sum(F.when(F.col("__zone") == z, 1).otherwise(0)) / F.count("*")).alias(f"{z}_court_ratio")
    made = moved.groupBy(*keys).agg(
        F.count("*").alias("frames_valid"), F.count("step").alias("distance_steps"), (F.count("*") - 1 - F.count("step")).alias("discontinuity_count"),
        F.coalesce(F.sum(F.when(F.col("step").isNotNull(), F.col("time_gap"))), F.lit(0.0)).alias("movement_duration_seconds"), F.sum("step").alias("total_distance_m"),
        F.avg(x).alias("mean_court_x"), F.avg(y).alias("mean_court_y"), share("front"), share("mid"), share("back"),
        *([F.collect_set(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("__points")] if with_hull else []),
    )
    eligible = F.col("distance_steps") > 0
    made = made.withColumn("avg_speed_m_s", F.when(eligible, F.try_divide("total_distance_m", "movement_duration_seconds")))
    if with_hull:
        made = made.withColumn("__hull", g.convex_hull(F.col("__points"))).withColumn("coverage_area_m2", g.shoelace(F.col("__hull"))).drop("__points", "__hull")
    made = made.withColumn("movement_eligibility", F.when(eligible, "eligible").otherwise("not_eligible"))
    same = [made[k].eqNullSafe(rejected[k]) for k in keys]  # positions without a key are a group too
    return made.join(rejected, same).drop(*(rejected[k] for k in keys))


def player_report(positions: DataFrame, expected: DataFrame, keys: list[str] = KEYS, group: str = "rally_id", x: str = "court_x", y: str = "court_y") -> DataFrame:
    """Report metrics by player; expected: (group, expected_frames)."""
    rows = positions.withColumn("__ok", on_own_half(x, y))
    tracked = rows.groupBy(*keys).agg(F.count("*").alias("tracked_rows"))
    moved = steps(rows.where("__ok"), keys, x, y)
    made = moved.groupBy(*keys).agg(
        F.count("*").alias("valid_frames"), F.sum("step").alias("total_distance_m"), F.coalesce(F.sum(F.when(F.col("step").isNotNull(), F.col("time_gap"))), F.lit(0.0)).alias("movement_duration_seconds"),
        F.max("speed").alias("maximum_speed_m_s"), F.max_by("speed", F.when(F.col("speed").isNotNull(), F.struct("frame_id", x, y))).alias("current_speed_m_s"),
    )
    out = tracked.join(made, keys, "left").join(expected, group, "left")
    out = out.withColumns({"valid_frames": F.coalesce("valid_frames", F.lit(0)), "movement_duration_seconds": F.coalesce("movement_duration_seconds", F.lit(0.0))})
    return out.withColumns({"average_speed_m_s": F.try_divide("total_distance_m", "movement_duration_seconds"), "tracking_coverage_ratio": F.try_divide(F.col("valid_frames"), F.col("expected_frames"))})


def trimmed(speeds: DataFrame, keys: list[str], speed: str = "speed") -> DataFrame:
    """speeds without outliers: of five or more, those above max(3 medians, min(99th percentile, median + 8 median deviations or 4 medians)) go."""
    w = Window.partitionBy(*keys)
    d = speeds.withColumn("__m", F.percentile(speed, F.lit(0.5)).over(w)).withColumn("__n", F.count(speed).over(w))
    d = d.withColumn("__mad", F.percentile(F.abs(F.col(speed) - F.col("__m")), F.lit(0.5)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(speed)))
    p99 = F.max(F.when(F.col("__r") == F.floor((F.col("__n") - 1) * 0.99) + 1, F.col(speed))).over(w)
    robust = F.when(F.col("__mad") > 0, F.col("__m") + 8 * F.col("__mad")).otherwise(F.col("__m") * 4)
    d = d.withColumn("__limit", F.greatest(F.col("__m") * 3, F.least(p99, robust)))
    return d.where((F.col("__n") < 5) | (F.col(speed) <= F.col("__limit"))).drop("__m", "__n", "__mad", "__r", "__limit")


def shuttle_report(track: DataFrame, keys: list[str], observed: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Image speeds of observed points a frame apart, without outliers, and how much of the track was observed."""
    rows = track.withColumn("__o", observed)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("expected_frames"), F.sum(F.col("__o").cast("int")).cast("bigint").alias("valid_observed_frames"))
    speeds = trimmed(steps(rows.where("__o"), keys, x, y, max_speed=None).where("speed is not null"), keys)
    made = speeds.groupBy(*keys).agg(F.avg("speed").alias("average_image_speed_px_s"), F.max("speed").alias("maximum_image_speed_px_s"), F.max_by("speed", "frame_id").alias("current_image_speed_px_s"))
    return counts.join(made, keys, "left").withColumn("visibility_ratio", F.col("valid_observed_frames") / F.col("expected_frames"))


def match_rollup(reports: DataFrame, by: list[str]) -> DataFrame:
    """Reports of rallies added up: distance without nulls, speed weighted by duration, zones by frames."""
    weighed = lambda c: F.try_divide(F.sum(F.col(c) * F.col("frames_valid")), F.sum("frames_valid")).alias(c)
    return reports.groupBy(*by).agg(
        F.count("*").alias("rallies"), F.sum("frames_valid").alias("frames_valid"), F.sum("total_distance_m").alias("total_distance_m"), F.sum("movement_duration_seconds").alias("movement_duration_seconds"),
        F.try_divide(F.sum("total_distance_m"), F.sum(F.when(F.col("total_distance_m").isNotNull(), F.col("movement_duration_seconds")))).alias("average_speed_m_s"),
        *(weighed(f"{z}_court_ratio") for z in ("front", "mid", "back")),
    )


def density(points: DataFrame, keys: list[str], x: Column, y: Column, width: float, height: float, columns: int, rows: int) -> DataFrame:
    """(keys, column, row, points): counts by equal cells of the area from (0, 0); points on the far edges belong to the last cells."""
    cell = lambda v, size, n: F.least(F.floor(v / size * n), F.lit(n - 1)).cast("bigint")
    inside = x.between(0, width) & y.between(0, height)
    return points.where(inside).groupBy(*keys, cell(x, width, columns).alias("column"), cell(y, height, rows).alias("row")).agg(F.count("*").alias("points"))


def strided_stats(points: DataFrame, keys: list[str], x: str, y: str, stride: int = 5, least: float = 0.05, max_speed: float = 8.0, time: str = "timestamp", frame: str = "frame_id") -> DataFrame:
    """Distance over every stride-th position and the last, where steps of between `least` metres and what max_speed allows count; the average is over the whole time."""
    w, whole = in_order(keys, x, y, frame), Window.partitionBy(*keys)
    d = points.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(whole)})
    picked = d.where((F.col("__i") % stride == 0) | (F.col("__i") == F.col("__n") - 1))
    made = picked.withColumns({"__d": g.length(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), "__t": F.col(time) - F.lag(time).over(w)})
    counts = (F.col("__d") > least) & (F.col("__d") < max_speed * F.col("__t"))
    return made.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.coalesce(F.sum(F.when(counts, F.col("__d"))), F.lit(0.0)).alias("distance_m"), F.coalesce(F.max(F.when(counts, F.col("__d") / F.col("__t"))), F.lit(0.0)).alias("max_speed_m_s"), (F.max(time) - F.min(time)).alias("elapsed")
    ).withColumn("avg_speed_m_s", F.coalesce(F.try_divide("distance_m", "elapsed"), F.lit(0.0)))


def projection_quality(positions: DataFrame, keys: list[str], x: str = "court_x", y: str = "court_y", margin: float = 0.1, absurd: float = 3.0) -> DataFrame:
    """Shares of positions off the court, absurdly far off and by its edge, and a score that falls with them."""
    px, py = F.col(x), F.col(y)
    off = ~(px.between(0, g.WIDTH_M) & py.between(0, g.LENGTH_M))
    far = ~(px.between(-absurd, g.WIDTH_M + absurd) & py.between(-absurd, g.LENGTH_M + absurd))
    edge = ~off & ((px < margin) | (px > g.WIDTH_M - margin) | (py < margin) | (py > g.LENGTH_M - margin))
    share = lambda c: F.avg(c.cast("int"))
    made = positions.where(px.isNotNull() & py.isNotNull()).groupBy(*keys).agg(F.count("*").alias("rows"), share(off).alias("outlier_ratio"), share(far).alias("absurd_ratio"), share(edge).alias("boundary_ratio"))
    return made.withColumn("quality_score", g.clamp(1 - F.col("outlier_ratio") - F.col("absurd_ratio") - 0.5 * F.col("boundary_ratio"), 0, 1))


def usable_shuttle(rows: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """(keys, frame, x, y, n): a smoothed shuttle track's points (texts sx, sy, x, y, ok) that tactics may use, numbered by frame."""
    p = coerce.either_point(("sx", "sy"), ("x", "y"))
    d = rows.where(coerce.literal_true("ok")).select(*keys, frame, p.alias("p")).where("p is not null")
    return d.select(*keys, frame, "p.x", "p.y", F.row_number().over(Window.partitionBy(*keys).orderBy(frame)).alias("n"))


def chart_points(rows: DataFrame, min_confidence: float) -> DataFrame:
    """Player rows that a chart shows, with x and y: near or far, valid after smoothing, sure enough, on the court. A smoothed
    coordinate of 0 counts as none, as for null."""
    pick = lambda s, r: F.coalesce(F.nullif(F.col(s), F.lit(0.0)), F.col(r))
    d = rows.where(F.col("player_id").isin("near", "far") & (F.col("is_smoothed_valid") == 1) & (F.col("confidence") >= min_confidence))
    d = d.withColumns({"x": pick("smoothed_court_x", "court_x"), "y": pick("smoothed_court_y", "court_y")})
    return d.where(F.col("x").between(0, g.WIDTH_M) & F.col("y").between(0, g.LENGTH_M))
