"""What an overlay or a report shows at a frame: lookups, markers, texts, panels, and the tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import geometry as g
from .segments import within_intervals
from .smoothing import by_frame

RALLY = ["video_stem", "rally_id"]


def last_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key, as a lookup filled in order has it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() if isinstance(c, Column) else F.desc(c) for c in order]))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def rally_sizes(rows: DataFrame, keys: list[str] = RALLY) -> DataFrame:
    """Rows by the identity of a rally, video and rally id, blank where missing; frame ids repeat between rallies."""
    return rows.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).agg(F.count("*").alias("rows"))


def active_events(frames: DataFrame, events: DataFrame, keys: list[str], hold: int, order: list[str], frame: str = "frame_id") -> DataFrame:
    """frames with the last event (by order) whose candidate frame is at most `hold` frames away; frames without any go."""
    reach = events.withColumns({"__from": F.col("candidate_frame") - hold, "__to": F.col("candidate_frame") + hold + 1})
    return last_by(within_intervals(frames, reach, keys, frame, "__from", "__to"), [*keys, frame], order).drop("__from", "__to")


def active_phases(frames: DataFrame, phases: DataFrame, keys: list[str], order: list[str], frame: str = "frame_id") -> DataFrame:
    """frames with the first eligible phase (by order) whose [start_frame, end_frame) holds them."""
    n = F.row_number().over(Window.partitionBy(*keys, frame).orderBy(*order))
    return within_intervals(frames, phases.where("phase_eligibility = 'eligible'"), keys, frame).withColumn("__n", n).where("__n = 1").drop("__n")


def marker(body: Column, body_valid: Column, ground: Column) -> Column:
    """Where a player is marked: the body's point if it is there and not marked invalid, else the ground's."""
    return F.when(body["x"].isNotNull() & body["y"].isNotNull() & ~coerce.literal_false(body_valid), body).otherwise(ground)


def summary_text(player: Column, eligibility: Column, distance: Column, speed: Column, event_eligibility: Column, candidates: Column) -> Column:
    """One player's line of a rally's summary; what isn't eligible reads N/A, never 0."""
    moved = F.format_string("%.1fm  %.1fm/s", F.coalesce(distance, F.lit(0.0)), F.coalesce(speed, F.lit(0.0)))
    found = F.concat(F.lit("reversal candidates "), F.coalesce(candidates, F.lit(0)).cast("string"))
    return F.concat(player, F.lit(": "), F.when(eligibility == "not_eligible", "movement N/A").otherwise(moved), F.lit("  "), F.when(event_eligibility == "not_eligible", "events N/A").otherwise(found))


def on_last_frame(rows: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Only each key's last frame: a summary of the whole rally must not be shown before it."""
    return rows.withColumn("__last", F.max(frame).over(Window.partitionBy(*keys))).where(F.col(frame) == F.col("__last")).drop("__last")


def panel(points: DataFrame, keys: list[str], x: str, y: str, left: int, top: int, width: int, height: int) -> DataFrame:
    """(keys, shown, rejected): points that the top-down panel shows, and those off the court, which it counts and doesn't clamp."""
    inside = g.in_court(F.col(x), F.col(y))
    px = left + F.round(F.col(x) / g.WIDTH_M * width)
    return points.groupBy(*keys).agg(F.count_if(inside).alias("shown"), F.count_if(~inside & F.col(x).isNotNull() & F.col(y).isNotNull()).alias("rejected"), F.min(F.when(inside, px)).cast("int").alias("leftmost"))


def public(rows: DataFrame, digits: int = 3) -> DataFrame:
    """The columns that a report shows: those without a leading _, floats rounded."""
    return rows.select(*(coerce.rounded(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes if not c.startswith("_")))


def ends(track: DataFrame, keys: list[str], x: str = "x", y: str = "y", frame: str = "frame_id") -> DataFrame:
    """(keys, points, start_x, start_y, end_x, end_y): a trajectory's first and last point."""
    p = F.struct(frame, x, y)
    d = track.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("points"), F.min(p).alias("a"), F.max(p).alias("b"))
    return d.select(*keys, "points", F.col(f"a.{x}").alias("start_x"), F.col(f"a.{y}").alias("start_y"), F.col(f"b.{x}").alias("end_x"), F.col(f"b.{y}").alias("end_y"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]], margin: float = 0.0) -> Column:
    """Whether a point lies in a convex polygon of plain numbers, its edges moved outwards by the margin."""
    area = sum(corners[i][0] * corners[(i + 1) % len(corners)][1] - corners[(i + 1) % len(corners)][0] * corners[i][1] for i in range(len(corners)))
    sign, inside = 1 if area > 0 else -1, F.lit(True)
    for i, (ax, ay) in enumerate(corners):
        bx, by = corners[(i + 1) % len(corners)]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        inside = inside & (sign * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) >= -margin * length)
    return inside


def recent_speed(track: DataFrame, keys: list[str], fps: float, x: str = "x", y: str = "y", frame: str = "frame_id", stride: int = 5, least: float = 0.05, max_speed: float = 8.0) -> DataFrame:
    """track with current_speed more: over the last half second of positions, every stride-th from its first and the last one, where steps of more
    than `least` metres and less than max_speed allows count, by the time of those; at most max_speed, 0 without any."""
    w, half = by_frame(keys, frame), int(fps / 2)
    d = track.withColumn("__w", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w.rowsBetween(-half, 0)))
    n = F.size("__w")
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), n - 1, F.lit(stride)), F.array(n - 1)))

    def step(i):
        a, b = F.get(at, i), F.get(at, i + 1)
        p, q = F.get(F.col("__w"), a), F.get(F.col("__w"), b)
        return F.struct(F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("d"), (b - a).alias("n"))

    steps = F.when(F.size(at) > 1, F.transform(F.sequence(F.lit(0), F.size(at) - 2), step)).otherwise(F.array().cast("array<struct<d:double,n:int>>"))
    good = F.filter(steps, lambda s: (s["d"] > least) & (s["d"] < max_speed / fps * s["n"]))
    total = lambda c: F.aggregate(good, F.lit(0.0), lambda a, s: a + s[c])
    speed = F.when(F.size(good) > 0, F.least(F.lit(max_speed), total("d") / (total("n") / fps))).otherwise(0.0)
    return d.withColumn("current_speed", speed).drop("__w")


def classification_outcome(eligibility: Column, reason: Column) -> Column:
    """eligible, else the reason, else not_classified."""
    return F.when(eligibility == "eligible", "eligible").otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("not_classified")))


def review_draft(events: DataFrame, version: str) -> DataFrame:
    """What a reviewer gets of each event: where it is, what was decided, and blanks to fill in."""
    blank = {n: F.lit("") for n in ("true_frame", "true_player_id", "true_stroke_class", "review_notes")}
    outcome = classification_outcome(F.col("classification_eligibility"), F.col("classification_reject_reason"))
    return events.select("video_stem", "rally_id", "event_id", "candidate_frame", "player_id", outcome.alias("outcome"), F.lit("pending").alias("review_status"), F.lit(version).alias("draft_version")).withColumns(blank)


def rejected_phases(events: DataFrame, keys: list[str], reason: Column, version: str) -> DataFrame:
    """The single row that an event without phases leaves: no phase, no frames, and why."""
    return events.select(*keys, F.lit(None).cast("string").alias("phase"), F.lit(None).cast("bigint").alias("start_frame"), F.lit(None).cast("bigint").alias("end_frame"), F.lit("not_eligible").alias("phase_eligibility"), reason.alias("phase_reject_reason"), F.lit(version).alias("phase_version"))


def enrich(events: DataFrame, stability: DataFrame, footwork: DataFrame, keys: list[str], player: str = "player_id", far: bool = True) -> DataFrame:
    """events with their descriptors; an event without a whole window, and a far player's footwork where that is off, say why instead."""
    own = [*keys, "event_id"]
    broken = F.col("window_start_frame").isNull() | F.col("window_end_frame").isNull() | F.col("candidate_frame").isNull()
    off = F.lit(not far) & (F.col(player) == "far")
    d = events.join(stability, own, "left").join(footwork, own, "left")
    out = {}
    for kind, also in (("stability", F.lit(False)), ("footwork", off)):
        out[f"{kind}_reject_reason"] = F.when(broken, "invalid_event_window").when(also, "far_player_analysis_disabled").otherwise(F.col(f"{kind}_reject_reason"))
        out[f"{kind}_eligibility"] = F.when(broken | also, "not_eligible").otherwise(F.col(f"{kind}_eligibility"))
    return d.withColumns(out)


def input_coverage(events: DataFrame, players: DataFrame, shuttle: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, own, opponent, shuttle): shares of an event window's frames with the player's pose, the opponent's position and the shuttle."""
    e = events.select(*keys, "event_id", F.col("player_id").alias("who"), "window_start_frame", "window_end_frame")
    span = F.col("window_end_frame") - F.col("window_start_frame")
    p = within_intervals(players, e, keys, start="window_start_frame", end="window_end_frame").groupBy(*keys, "event_id").agg(
        F.countDistinct(F.when(F.col("player_id") == F.col("who"), F.col("frame_id"))).alias("own"), F.countDistinct(F.when(F.col("player_id") != F.col("who"), F.col("frame_id"))).alias("opponent")
    )
    s = within_intervals(shuttle, e, keys, start="window_start_frame", end="window_end_frame").groupBy(*keys, "event_id").agg(F.countDistinct("frame_id").alias("shuttle"))
    d = e.join(p, [*keys, "event_id"], "left").join(s, [*keys, "event_id"], "left")
    return d.select(*keys, "event_id", *((F.coalesce(n, F.lit(0)) / span).alias(n) for n in ("own", "opponent", "shuttle")))


def clamped_totals(rows: DataFrame, key: str, numbers: list[str], order: list) -> DataFrame:
    """A summary by key, of repeated keys the last row, with 0 for every number that doesn't read."""
    d = last_by(rows, [key], order)
    return d.select(key, *(F.coalesce(coerce.number(n), F.lit(0.0)).alias(n) for n in numbers))
