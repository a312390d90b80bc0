"""Plane geometry as Column expressions: points, boxes, projective maps, polygons."""

from __future__ import annotations

from functools import reduce
from math import acos

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH_M, LENGTH_M, NET_M = 6.10, 13.40, 6.70


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between."""
    return clamp((x - low) / (high - low), 0, 1)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def length(x: Column, y: Column) -> Column:
    """Of a vector, as SQL has it to the last bit: hypot may round otherwise, which decides between equal angles and distances."""
    return F.sqrt(x * x + y * y)


def cosine_between(ux: Column, uy: Column, vx: Column, vy: Column, shortest: float = 1e-9) -> Column:
    """Of the angle between two vectors; null if either is no longer than `shortest`."""
    n, m = length(ux, uy), length(vx, vy)
    return F.when((n > shortest) & (m > shortest), clamp((ux * vx + uy * vy) / (n * m), -1, 1))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column, shortest: float = 1e-9) -> Column:
    """Degrees between two vectors; null if either is no longer than `shortest`."""
    return F.degrees(F.acos(cosine_between(ux, uy, vx, vy, shortest)))


def acos_as_sql(cosine: Column) -> Column:
    """The C library's, as SQL has it to the last bit, at the price of a Python worker: the JVM's may round otherwise, and so part angles that are equal there."""

    def each(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else acos(v) for v in values.to_pylist()], pa.float64())

    return F.arrow_udf(each, "double")(cosine)


def vertex_angle(a, b, c) -> Column:
    """Degrees at b between the points a and c, as (x, y) Columns."""
    return angle_between(a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1])


def project(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """The point under a 3x3 matrix; null where the denominator is nearly 0."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    safe = F.when(F.abs(w) >= 1e-9, w)
    return (h[0][0] * x + h[0][1] * y + h[0][2]) / safe, (h[1][0] * x + h[1][1] * y + h[1][2]) / safe


def inverse(h: list[list[float]]) -> list[list[float]]:
    """Of a 3x3 matrix, by its adjugate."""
    (a, b, c), (d, e, f), (g, i, j) = h
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    if abs(det) < 1e-12:
        raise ValueError("a singular matrix")
    adjugate = [[e * j - f * i, c * i - b * j, b * f - c * e], [f * g - d * j, a * j - c * g, c * d - a * f], [d * i - e * g, b * g - a * i, a * e - b * d]]
    return [[v / det for v in row] for row in adjugate]


def perspective(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[list[float]]:
    """The matrix that maps four points to four others (driver side: one small system of a calibration)."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3).tolist()


def iou(a: tuple, b: tuple) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) by their union; 0 if they have no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    either = area(a) + area(b) - w * h
    return F.when(either > 0, w * h / either).otherwise(0.0)


def clamp_box(box: tuple, width: float, height: float) -> tuple:
    """A box moved into a frame, at least one pixel wide and high."""
    x1, y1 = clamp(box[0], 0, width - 2), clamp(box[1], 0, height - 2)
    return x1, y1, F.greatest(x1 + 1, F.least(F.lit(float(width - 1)), box[2])), F.greatest(y1 + 1, F.least(F.lit(float(height - 1)), box[3]))


def shift_box(box: tuple, dx: Column, dy: Column, width: float, height: float) -> tuple:
    """A box shifted, brought to whole pixels and moved into the frame."""
    return clamp_box((F.round(box[0] + dx), F.round(box[1] + dy), F.round(box[2] + dx), F.round(box[3] + dy)), width, height)


def box_height(top: Column, bottom: Column) -> Column:
    """null unless the bottom is below the top."""
    return F.when(bottom - top > 1e-9, bottom - top)


def square_to_quad(corners) -> list[list[Column]]:
    """The 3x3 matrix, of Columns, that maps the unit square's corners (0,0) (1,0) (1,1) (0,1) to four points; null for degenerate ones."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    ax, bx, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    ay, by, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    area = ax * by - bx * ay
    safe = F.when(F.abs(area) > 1e-12, area)
    g, h = (sx * by - bx * sy) / safe, (ax * sy - sx * ay) / safe
    return [[x1 - x0 + g * x1, x3 - x0 + h * x3, x0], [y1 - y0 + g * y1, y3 - y0 + h * y3, y0], [g, h, F.lit(1.0)]]


def determinant(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def court_corners_from_lines(x_lines: list[tuple], y_lines: list[tuple]) -> list[tuple[Column, Column]]:
    """The four doubles corners in the image, in or out of the frame, from two lines along the court and two across.

    Each line is (metres, (x1, y1, x2, y2) in the image); metres are plain numbers. Their four intersections are a known
    rectangle of the court, whose projection is carried on to the corners. Null for lines that are parallel in the image.
    """
    (xa, left), (xb, right) = sorted(x_lines, key=lambda t: t[0])
    (ya, far), (yb, near) = sorted(y_lines, key=lambda t: t[0])
    if xb - xa < 1e-6 or yb - ya < 1e-6:
        raise ValueError("two different lines along the court and two across are needed")
    h = square_to_quad([line_intersection(left, far), line_intersection(right, far), line_intersection(right, near), line_intersection(left, near)])
    return [project(h, F.lit((x - xa) / (xb - xa)), F.lit((y - ya) / (yb - ya))) for x, y in ((0, 0), (WIDTH_M, 0), (WIDTH_M, LENGTH_M), (0, LENGTH_M))]


#: The regulation lines of a court in metres, (name, x1, y1, x2, y2, weight).
COURT_LINES = (
    ("far_baseline", 0.0, 0.0, 6.10, 0.0, 1.35),
    ("right_doubles_sideline", 6.10, 0.0, 6.10, 13.40, 1.35),
    ("near_baseline", 6.10, 13.40, 0.0, 13.40, 1.35),
    ("left_doubles_sideline", 0.0, 13.40, 0.0, 0.0, 1.35),
    ("left_singles_sideline", 0.46, 0.0, 0.46, 13.40, 0.95),
    ("right_singles_sideline", 5.64, 0.0, 5.64, 13.40, 0.95),
    ("far_doubles_long_service", 0.0, 0.76, 6.10, 0.76, 1.0),
    ("near_doubles_long_service", 0.0, 12.64, 6.10, 12.64, 1.0),
    ("far_short_service", 0.0, 4.72, 6.10, 4.72, 1.15),
    ("near_short_service", 0.0, 8.68, 6.10, 8.68, 1.15),
    ("far_center", 3.05, 0.0, 3.05, 4.72, 0.8),
    ("near_center", 3.05, 8.68, 3.05, 13.40, 0.8),
    ("net", 0.0, 6.70, 6.10, 6.70, 0.35),
)


def projected_lines(corners) -> Column:
    """array<struct<name,weight,x1,y1,x2,y2>>: the court's lines in the image, given its four corners there."""
    h = square_to_quad(corners)
    matrix = F.struct(*(v.alias(f"m{i}{j}") for i, row in enumerate(h) for j, v in enumerate(row)))
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), *(F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x1 / WIDTH_M, y1 / LENGTH_M, x2 / WIDTH_M, y2 / LENGTH_M)))) for n, x1, y1, x2, y2, w in COURT_LINES))

    def in_image(m, line):
        at = [[m[f"m{i}{j}"] for j in range(3)] for i in range(3)]
        (ax, ay), (bx, by) = project(at, line["x1"], line["y1"]), project(at, line["x2"], line["y2"])
        return F.struct(line["name"].alias("name"), line["weight"].alias("weight"), ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))

    # the matrix is bound once: written out in each line's four numbers it would be a plan of its own
    return F.get(F.transform(F.array(matrix), lambda m: F.transform(known, lambda line: in_image(m, line))), F.lit(0))


def in_court(x: Column, y: Column, margin: float = 0.0) -> Column:
    return F.coalesce(x.between(-margin, WIDTH_M + margin) & y.between(-margin, LENGTH_M + margin), F.lit(False))


def unit_to_pixels(corners, width: float, height: float, out_of_bounds: bool = False) -> list[tuple[Column, Column]]:
    """Corners given by parts of the frame in pixels; null where any lies outside it, unless that is allowed."""
    inside = reduce(lambda a, b: a & b, (v.between(0, 1) for p in corners for v in p))
    keep = (lambda v: v) if out_of_bounds else (lambda v: F.when(inside, v))
    return [(keep(x * width), keep(y * height)) for x, y in corners]


def segment_features(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct<angle,length,mx,my> of a line segment; the angle in degrees from 0 to 180."""
    angle = F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))
    return F.struct(angle.alias("angle"), F.hypot(x2 - x1, y2 - y1).alias("length"), ((x1 + x2) / 2).alias("mx"), ((y1 + y2) / 2).alias("my"))


def segment_class(angle: Column) -> Column:
    """Across the court if within 20 degrees of level, along it from 45 to 135 degrees."""
    return F.when((angle <= 20) | (angle >= 160), "across").when(angle.between(45, 135), "along")


def bottom_centre(box: tuple) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, box[3]


def own_depth(player, y: Column) -> Column:
    """Metres from the net into the player's own half."""
    return clamp(F.when(player == "near", y - NET_M).otherwise(NET_M - y), 0, NET_M)


def zone(depth: Column) -> Column:
    return F.when(depth < 2.5, "front").when(depth > 4.5, "back").otherwise("mid")


def shoelace(points: Column) -> Column:
    """Area of a polygon given as array<struct<x,y>>; 0 under three points."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (i % n + 1).cast("int"))
    crosses = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(n >= 3, F.abs(F.aggregate(crosses, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)


def _half_hull(points: Column) -> Column:
    """One chain of a convex hull over sorted points: a fold whose state is the chain so far."""
    start = F.slice(points, 1, 0)

    def turns(a, b, p):
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) > 0

    def add(chain, p):
        # the chain up to its last edge from which p is a left turn; earlier edges of a convex chain turn left too
        kept = F.filter(F.sequence(F.lit(2), F.greatest(F.size(chain), F.lit(2))), lambda i: (i <= F.size(chain)) & turns(F.get(chain, i - 2), F.get(chain, i - 1), p))
        n = F.coalesce(F.array_max(kept), F.least(F.size(chain), F.lit(1)))
        return F.concat(F.slice(chain, F.lit(1), n), F.array(p))

    return F.aggregate(points, start, add)


def convex_hull(points: Column) -> Column:
    """Corners of the convex hull of array<struct<x,y>>, counter-clockwise from the least point; of collinear points the ends alone."""
    ordered = F.array_sort(F.array_distinct(points))
    low, high = _half_hull(ordered), _half_hull(F.reverse(ordered))
    both = F.concat(F.slice(low, F.lit(1), F.size(low) - 1), F.slice(high, F.lit(1), F.size(high) - 1))
    return F.when(F.size(ordered) < 2, ordered).otherwise(both)


def mean_corner_distance(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda s, t: s + t, (distance(*p, *q) for p, q in zip(a, b))) / len(a)


def corner_rmse(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]], width: float, height: float) -> Column:
    """Root mean square of corner offsets, by width and height."""
    squares = [((p[0] - q[0]) / width) ** 2 + ((p[1] - q[1]) / height) ** 2 for p, q in zip(a, b)]
    return F.sqrt(reduce(lambda s, t: s + t, squares) / len(a))


def line_intersection(a: tuple, b: tuple) -> tuple[Column, Column]:
    """Of two lines, each (x1, y1, x2, y2); null for parallels."""
    def line(s):
        return s[1] - s[3], s[2] - s[0], s[0] * s[3] - s[2] * s[1]

    (a1, b1, c1), (a2, b2, c2) = line(a), line(b)
    w = a1 * b2 - a2 * b1
    safe = F.when(F.abs(w) >= 1e-9, w)
    return (b1 * c2 - b2 * c1) / safe, (c1 * a2 - c2 * a1) / safe


def rescaled(x: Column, y: Column, source: tuple[int, int], target: tuple[int, int]) -> tuple[Column, Column]:
    """A point of a frame of one size (width, height) in a frame of another."""
    return x * (target[0] / source[0]), y * (target[1] / source[1])


def in_padded_roi(x: Column, y: Column, roi: tuple[float, float, float, float], pad_x: float, pad_y: float) -> Column:
    """Whether a point lies in a region (x1, y1, x2, y2) widened to all sides."""
    return x.between(roi[0] - pad_x, roi[2] + pad_x) & y.between(roi[1] - pad_y, roi[3] + pad_y)
