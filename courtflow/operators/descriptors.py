"""Descriptions of an event's window: stability, footwork, crossed steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import within_intervals
from .smoothing import by_frame


def window_rows(events: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows within each event's [window_start_frame, window_end_frame), with event_id and candidate_frame."""
    e = events.select(*keys, "event_id", "candidate_frame", "window_start_frame", "window_end_frame")
    return within_intervals(rows, e, keys, start="window_start_frame", end="window_end_frame")


def stability(events: DataFrame, kinematics: DataFrame, keys: list[str], min_rows: int = 5, wide: float = 0.35) -> DataFrame:
    """Means over the eligible rows of an event's window; too few give the reason instead.

    kinematics: support_width_ratio, body_support_offset_ratio, trunk_lean_deg, left_knee_angle_deg, right_knee_angle_deg, kinematics_eligibility.
    """
    rows = window_rows(events, kinematics.where("kinematics_eligibility = 'eligible'"), keys)
    made = rows.groupBy(*keys, "event_id").agg(
        F.count("*").alias("rows"), F.avg("support_width_ratio").alias("mean_support_width_ratio"), F.sqrt(F.avg(F.col("body_support_offset_ratio") ** 2)).alias("body_support_offset_rms"),
        F.when(F.count("trunk_lean_deg") >= 2, F.stddev_pop("trunk_lean_deg")).alias("trunk_sway_std_deg"), F.avg(F.abs(F.col("left_knee_angle_deg") - F.col("right_knee_angle_deg"))).alias("mean_knee_asymmetry_deg"),
        (F.max("support_width_ratio") >= wide).cast("int").alias("wide_support_candidate"),
    )
    out = events.select(*keys, "event_id").join(made, [*keys, "event_id"], "left")
    ok = F.coalesce("rows", F.lit(0)) >= min_rows
    names = ("mean_support_width_ratio", "body_support_offset_rms", "trunk_sway_std_deg", "mean_knee_asymmetry_deg", "wide_support_candidate")
    return out.select(*keys, "event_id", F.when(ok, "eligible").otherwise("not_eligible").alias("stability_eligibility"), F.when(ok, "").otherwise("insufficient_kinematics_rows").alias("stability_reject_reason"), *(F.when(ok, F.col(n)).alias(n) for n in names))


def footwork(events: DataFrame, positions: DataFrame, keys: list[str], min_rows: int = 5, start: float = 0.5, home: float = 0.35) -> DataFrame:
    """Paths before and after an event, its fastest step, when movement began, braked and came home; too few positions give the reason instead.

    positions: frame_id, timestamp, court_x, court_y. All windows part by the event, so one shuffle serves them.
    """
    own = [*keys, "event_id"]
    w, whole = by_frame(own), Window.partitionBy(*own)
    seen = positions.where("court_x is not null and court_y is not null and timestamp is not null")
    d = window_rows(events, seen, keys)
    c, f, t = F.col("candidate_frame"), F.col("frame_id"), F.col("timestamp")
    d = d.withColumns({"__d": F.hypot(F.col("court_x") - F.lag("court_x").over(w), F.col("court_y") - F.lag("court_y").over(w)), "__t": t - F.lag("timestamp").over(w), "__g": f - F.lag("frame_id").over(w)})
    d = d.withColumns({"speed": F.when((F.col("__t") > 0) & (F.col("__g") <= 2), F.col("__d") / F.col("__t")), "x0": F.first("court_x").over(w), "y0": F.first("court_y").over(w), "__first_after": F.min(F.when(f >= c, f)).over(whole)})
    back = (f > F.col("__first_after")) & (F.hypot(F.col("court_x") - F.col("x0"), F.col("court_y") - F.col("y0")) <= home)
    near = F.min(F.struct(F.abs(f - c).alias("a"), f.alias("f"), t.alias("t")))
    made = d.groupBy(*own, "candidate_frame").agg(
        F.count("*").alias("n"), F.sum((f <= c).cast("int")).alias("nb"), F.sum((f >= c).cast("int")).alias("na"), F.coalesce(F.sum(F.when(f <= c, F.col("__d"))), F.lit(0.0)).alias("pre_contact_displacement_m"),
        F.coalesce(F.sum(F.when(f > F.col("__first_after"), F.col("__d"))), F.lit(0.0)).alias("post_contact_displacement_m"), F.sum("__d").alias("event_path_distance_m"), F.max("speed").alias("max_footwork_speed_m_s"),
        F.min(F.when(F.col("speed") >= start, f)).alias("movement_start_frame"), F.min(F.when((f > c) & (F.col("speed") < start), f)).alias("braking_frame"), F.min(F.when(back, F.struct(f.alias("f"), t.alias("t")))).alias("home"), near.alias("contact"),
    )
    made = made.withColumns({"recovery_frame": F.col("home.f"), "recovery_time_s": F.col("home.t") - F.col("contact.t")})
    out = events.select(*own).join(made, own, "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < min_rows, "insufficient_valid_court_positions").when((F.col("nb") < 2) | (F.col("na") < 2), "truncated_footwork_window").otherwise("")
    out = out.withColumn("footwork_reject_reason", reason)
    ok = F.col("footwork_reject_reason") == ""
    names = ("pre_contact_displacement_m", "post_contact_displacement_m", "event_path_distance_m", "max_footwork_speed_m_s", "recovery_time_s", "movement_start_frame", "braking_frame", "recovery_frame")
    return out.select(*own, F.when(ok, "eligible").otherwise("not_eligible").alias("footwork_eligibility"), "footwork_reject_reason", *(F.when(ok, F.col(n)).alias(n) for n in names))


def crossed_steps(rows: DataFrame, keys: list[str], difference: str, frame: str = "frame_id") -> DataFrame:
    """(keys, crossed): whether the sign of the ankles' distance changes; null under three signs."""
    signs = rows.where(F.abs(F.col(difference)) > 1e-6).withColumn("__s", F.signum(F.col(difference)))
    d = signs.withColumn("__c", F.col("__s") != F.lag("__s").over(by_frame(keys, frame)))
    return rows.select(*keys).distinct().join(d.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.coalesce(F.bool_or("__c"), F.lit(False))).alias("crossed")), keys, "left")


def dominant_side(rows: DataFrame, keys: list[str], sides: dict[str, tuple[str, str]], frame: str = "frame_id", time: str = "timestamp") -> DataFrame:
    """(keys, side, path): the side whose point travels furthest in steps of at most two frames; of equals the first named."""
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("side"), F.col(x).alias("px"), F.col(y).alias("py")) for i, (n, (x, y)) in enumerate(sides.items())))
    long = rows.select(*keys, frame, time, F.explode(parts).alias("p")).select(*keys, frame, time, "p.*").where("px is not null and py is not null")
    w = by_frame([*keys, "side"], frame)
    step = F.when((F.col(frame) - F.lag(frame).over(w) <= 2) & (F.col(time) > F.lag(time).over(w)), F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)))
    paths = long.withColumn("__d", step).groupBy(*keys, "i", "side").agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("path"))
    return paths.groupBy(*keys).agg(F.max(F.struct("path", (-F.col("i")).alias("i"), "side")).alias("m")).select(*keys, "m.side", "m.path")


def rally_summary(events: DataFrame, keys: list[str], numbers: list[str], reasons: list[str]) -> DataFrame:
    """Counts, means without nulls, and a JSON histogram of the reasons by rally."""
    counts = events.groupBy(*keys).agg(F.count("*").alias("events"), *(F.avg(n).alias(n) for n in numbers))
    each = events.select(*keys, F.explode(F.array(*(F.col(r) for r in reasons))).alias("reason")).where("coalesce(reason, '') <> ''").groupBy(*keys, "reason").count()
    histogram = each.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count"))))).alias("reasons"))
    return counts.join(histogram, keys, "left").withColumn("reasons", F.coalesce("reasons", F.lit("{}")))
