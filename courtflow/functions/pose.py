"""Pose keypoints: arrays of struct<name,x,y,confidence>, from and to JSON cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 17 joints in order, and the pairs that a skeleton connects.
NAMES = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
EDGES = (
    ("left_ear", "left_eye"), ("left_eye", "nose"), ("nose", "right_eye"), ("right_eye", "right_ear"),
    ("left_shoulder", "right_shoulder"), ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"), ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip"), ("left_hip", "right_hip"), ("left_hip", "left_knee"), ("left_knee", "left_ankle"), ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
)
KIND = "array<struct<name:string,x:double,y:double,confidence:double>>"


def parse(json: Column) -> Column:
    """Keypoints of a JSON cell; one malformed element empties the whole list, and so does any other JSON."""
    k = F.from_json(json, KIND)
    bad = k.isNull() | F.exists(k, lambda p: p.isNull() | p["name"].isNull() | p["x"].isNull() | p["y"].isNull() | p["confidence"].isNull())
    return F.when(bad, F.array().cast(KIND)).otherwise(k)


def to_json(keypoints: Column) -> Column:
    return F.to_json(F.transform(keypoints, lambda p: F.struct(p["name"].alias("name"), F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"), F.round(p["confidence"], 4).alias("confidence"))))


def valid(keypoints: Column, threshold: float) -> Column:
    return F.filter(keypoints, lambda p: (p["confidence"] >= threshold) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))


def mean_confidence(keypoints: Column) -> Column:
    total = F.aggregate(F.transform(keypoints, lambda p: p["confidence"]), F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size(keypoints) > 0, total / F.size(keypoints)).otherwise(0.0)


def point(keypoints: Column, name: str) -> Column:
    """struct of the joint of that name (the last, if several); null without one."""
    found = F.filter(keypoints, lambda p: p["name"] == name)
    return F.get(found, F.size(found) - 1)


def midpoint(keypoints: Column, a: str, b: str) -> tuple[Column, Column]:
    p, q = point(keypoints, a), point(keypoints, b)
    return (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2


def torso_centre(keypoints: Column) -> tuple[Column, Column]:
    """Between shoulders and hips, or where only one pair is there, its middle."""
    s, h = midpoint(keypoints, "left_shoulder", "right_shoulder"), midpoint(keypoints, "left_hip", "right_hip")
    return tuple(F.coalesce((a + b) / 2, a, b) for a, b in zip(s, h))


def edges(keypoints: Column) -> Column:
    """array<struct<a,b>> of the skeleton's edges with both joints there."""
    names = F.transform(keypoints, lambda p: p["name"])
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES))
    return F.filter(every, lambda e: F.array_contains(names, e["a"]) & F.array_contains(names, e["b"]))


def same_length(values: Column, length: int, zero: Column) -> Column:
    """An array brought to a length: every n-th element of a longer one, a shorter one filled up with `zero`."""
    stride = F.ceil(F.size(values) / length).cast("int")
    picked = F.filter(values, lambda v, i: i % stride == 0)
    taken = F.slice(F.when(F.size(values) > length, picked).otherwise(values), 1, length)
    return F.concat(taken, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(taken), F.lit(0))))


def build(coordinates: Column, confidences: Column | None = None) -> Column:
    """Keypoints of 17 points (array<array<double>>) and their confidences, kept within 0 and 1 (without any: 1); null unless there are 17 of each."""
    names = F.array(*map(F.lit, NAMES))
    sure = F.array_repeat(F.lit(1.0), len(NAMES)) if confidences is None else confidences
    made = F.zip_with(F.arrays_zip(names.alias("n"), coordinates.alias("p")), sure, lambda t, c: F.struct(
        t["n"].alias("name"), F.get(t["p"], F.lit(0)).alias("x"), F.get(t["p"], F.lit(1)).alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence")
    ))
    return F.when((F.size(coordinates) == len(NAMES)) & (F.size(sure) == len(NAMES)), made)


def candidate(keypoints: Column, threshold: float, least: int) -> Column:
    """struct<foot_x,foot_y,score,joints> of a detected person: the middle of the seen ankles, and the mean confidence of the seen joints;
    null for one of fewer than `least` joints or without an ankle."""
    seen = valid(keypoints, threshold)
    ankles = F.filter(seen, lambda p: p["name"].isin("left_ankle", "right_ankle"))
    mean = lambda c: F.aggregate(F.transform(ankles, lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / F.size(ankles)
    return F.when((F.size(seen) >= least) & (F.size(ankles) > 0), F.struct(mean("x").alias("foot_x"), mean("y").alias("foot_y"), mean_confidence(seen).alias("score"), F.size(seen).alias("joints")))


def by_name(keypoints: Column) -> Column:
    """map<name, struct<x,y,confidence>>; of several joints of a name the last."""
    names = F.array_distinct(F.transform(keypoints, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(keypoints, lambda p: p["name"] == n), -1)))


def trunk_lean(keypoints: Column) -> Column:
    """Degrees of the line from hips to shoulders off the upright, right is positive; null without all four joints or a length."""
    sx, sy = midpoint(keypoints, "left_shoulder", "right_shoulder")
    hx, hy = midpoint(keypoints, "left_hip", "right_hip")
    dx, up = sx - hx, hy - sy
    return F.when(F.hypot(dx, up) > 1e-9, F.degrees(F.atan2(dx, up)))


def stability(keypoints: Column, height: Column) -> tuple[Column, Column]:
    """Width between the ankles, and how far the trunk is right of their middle, by the box's height."""
    left, right = point(keypoints, "left_ankle"), point(keypoints, "right_ankle")
    sx, _ = midpoint(keypoints, "left_shoulder", "right_shoulder")
    hx, _ = midpoint(keypoints, "left_hip", "right_hip")
    return F.abs(left["x"] - right["x"]) / height, ((sx + hx) / 2 - (left["x"] + right["x"]) / 2) / height


def relative_wrist(keypoints: Column, side: str, height: Column, whole_torso: bool = False) -> tuple[Column, Column]:
    """A wrist from the torso's centre, by the box's height. whole_torso: only with both shoulders and both hips."""
    wrist = point(keypoints, f"{side}_wrist")
    if whole_torso:
        centre = tuple((a + b) / 2 for a, b in zip(midpoint(keypoints, "left_shoulder", "right_shoulder"), midpoint(keypoints, "left_hip", "right_hip")))
    else:
        centre = torso_centre(keypoints)
    return (wrist["x"] - centre[0]) / height, (wrist["y"] - centre[1]) / height


def proximity(keypoints: Column, height: Column, shuttle: tuple, body: tuple, reach: float) -> Column:
    """1 at the nearest wrist (without wrists, the body) down to 0 at `reach` box heights from it; 0 where anything is missing."""
    away = lambda x, y: F.hypot(shuttle[0] - x, shuttle[1] - y) / height
    wrists = F.transform(F.filter(keypoints, lambda p: p["name"].isin("left_wrist", "right_wrist")), lambda p: away(p["x"], p["y"]))
    near = F.coalesce(F.array_min(wrists), away(*body))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - near / reach)), F.lit(0.0))
