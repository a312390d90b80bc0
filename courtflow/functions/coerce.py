"""Scalar cleaning: text cells to numbers and flags, labels for reports. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """A number from text; blank or garbage is null, nan and inf texts stay."""
    return F.trim(_col(c).cast("string")).try_cast("double")


def finite(c) -> Column:
    """A finite number from text; anything else is null."""
    x = number(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def integer(c, default: int | None = None) -> Column:
    """The whole part of a number from text, else the default."""
    x = F.when(F.abs(finite(c)) < 9e18, finite(c)).cast("bigint")
    return x if default is None else F.coalesce(x, F.lit(default).cast("bigint"))


def truthy(c) -> Column:
    """Whether a text is 1, true or yes, whatever its case and outer blanks; null is false."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def rounded(c, digits: int = 3) -> Column:
    x = _col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits))


def rally_id(stem) -> Column:
    """The digits after a final `_rally_`, else 000."""
    found = F.regexp_extract(_col(stem), r"_rally_(\d+)$", 1)
    return F.when(found == "", "000").otherwise(F.coalesce(found, F.lit("000")))


def match_id(stem) -> Column:
    """A match's id: the stem of its file with _ for blanks."""
    return F.replace(_col(stem), F.lit(" "), F.lit("_"))


def chart_label(rally, stem) -> Column:
    """r<rally id>, else r<the digits after rally_ in the stem>, else the stem's last 12 characters, else unknown."""
    own, digits = F.nullif(_col(rally), F.lit("")), F.nullif(F.regexp_extract(_col(stem), r"rally_(\d+)", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("r"), own), F.concat(F.lit("r"), digits), F.nullif(F.right(_col(stem), F.lit(12)), F.lit("")), F.lit("unknown"))


def safe_name(c, longest: int = 120) -> Column:
    """A text as a file name: runs of other characters than letters, digits, _ . - become one _; no . or _ at the ends; event if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(_col(c), "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(name, 1, longest), F.lit("")), F.lit("event"))


def number_label(c, digits: int = 2) -> Column:
    return F.when(_col(c).isNotNull(), F.format_string(f"%.{digits}f", _col(c))).otherwise("—")


def percent_label(c, digits: int = 1) -> Column:
    return F.when(_col(c).isNotNull(), F.format_string(f"%.{digits}f%%", _col(c) * 100)).otherwise("—")


def duration_label(c, approximate: bool = False) -> Column:
    """Seconds under a minute, else minutes and hours, in the report's language; null is a dash. approximate: `about`, and `under a minute`."""
    x = F.greatest(_col(c), F.lit(0.0))
    minutes = F.greatest(F.floor(x / 60 + 0.5), F.lit(1))
    hours, rest = F.floor(minutes / 60), minutes % 60
    long = F.when(hours > 0, F.format_string("%d 小时 %d 分钟", hours, rest)).otherwise(F.format_string("%d 分钟", rest))
    short = F.lit("不足 1 分钟") if approximate else F.format_string("%d 秒", F.floor(x))
    return F.when(_col(c).isNull(), "—").when(x < 60, short).otherwise(F.concat(F.lit("约 "), long) if approximate else long)


def literal_true(c) -> Column:
    """Whether a text is 1, true or True, to the letter."""
    return F.coalesce(_col(c).cast("string").isin("1", "true", "True"), F.lit(False))


def literal_false(c) -> Column:
    return F.coalesce(_col(c).cast("string").isin("0", "false", "False"), F.lit(False))


def either_point(smoothed: tuple, raw: tuple) -> Column:
    """struct<x,y> of each coordinate's smoothed text or, where that is blank, its raw one; null unless both are numbers."""
    x, y = (number(F.coalesce(F.nullif(_col(s), F.lit("")), _col(r))) for s, r in zip(smoothed, raw))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def shuttle_point(smoothed: tuple, raw: tuple, smoothed_valid=None, visible=None) -> Column:
    """struct<x,y> of a shuttle row; null if it isn't valid after smoothing or, in a table that wasn't smoothed (no smoothed_valid), not visible."""
    gone = ~literal_true(smoothed_valid) if smoothed_valid is not None else literal_false(visible) if visible is not None else F.lit(False)
    sx, sy, x, y = (number(c) for c in (*smoothed, *raw)) if smoothed_valid is not None else (F.lit(None).cast("double"),) * 2 + tuple(number(c) for c in raw)
    use = sx.isNotNull() & sy.isNotNull()
    x, y = F.when(use, sx).otherwise(x), F.when(use, sy).otherwise(y)
    return F.when(~gone & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def shuttle_observed(interpolated, visibility, confidence, x, y, threshold: float) -> Column:
    """Whether a shuttle row is a real observation: not interpolated, visible, sure enough, with both coordinates."""
    return ~truthy(interpolated) & truthy(visibility) & (F.coalesce(finite(confidence), F.lit(0.0)) >= threshold) & finite(x).isNotNull() & finite(y).isNotNull()


def adapt_legacy(rows: DataFrame) -> DataFrame:
    """Track rows of the old schema, whose image_x, image_y always mean the ground, in the new one: rows without ground_image_x get the
    ground anchor from them and an empty body anchor; others stay as they are."""
    old = F.coalesce(F.col("ground_image_x"), F.lit("")) == ""
    there = (F.coalesce(F.col("image_x"), F.lit("")) != "") & (F.coalesce(F.col("image_y"), F.lit("")) != "")
    made = {
        "schema_version": F.lit("2.0-adapted-legacy"), "ground_image_x": F.coalesce("image_x", F.lit("")), "ground_image_y": F.coalesce("image_y", F.lit("")), "ground_anchor_source": F.lit("legacy_image_xy"),
        "ground_anchor_confidence": F.coalesce("confidence", F.lit("")), "ground_anchor_valid": F.when(there, "1").otherwise("0"), "body_image_x": F.lit(""), "body_image_y": F.lit(""),
        "body_anchor_source": F.lit(""), "body_anchor_confidence": F.lit(""), "body_anchor_valid": F.lit("0"),
    }
    return rows.withColumns({n: F.when(old, v).otherwise(F.col(n) if n in rows.columns else F.lit(None).cast("string")) for n, v in made.items()})


def cookie_source(url, default=None, youtube=None, olympics=None) -> Column:
    """Which cookie file a URL's download takes: its site's, else the default one; files are Columns or None."""
    lowered, or_null = F.lower(_col(url)), lambda c: F.lit(None).cast("string") if c is None else c
    video = F.contains(lowered, F.lit("youtube.com")) | F.contains(lowered, F.lit("youtu.be"))
    return F.when(video, F.coalesce(or_null(youtube), or_null(default))).when(F.contains(lowered, F.lit("olympics.com")), F.coalesce(or_null(olympics), or_null(default))).otherwise(or_null(default))


def is_playlist(c) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))) == "playlist", F.lit(False))


def entry_count(entries) -> Column:
    """How many downloads a list of entries stands for: those that aren't null; a null list is one."""
    return F.when(entries.isNull(), 1).otherwise(F.size(F.array_compact(entries)))


def unit_roi(c) -> Column:
    """array<double> x, y, width, height of a text `x,y,width,height` that fits into the unit square; else null."""
    parts = F.transform(F.split(_col(c), ","), lambda v: F.trim(v).try_cast("double"))
    fits = (F.size(parts) == 4) & F.forall(parts, lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False)))
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(fits & (at(2) > 0) & (at(3) > 0) & (at(0) + at(2) <= 1) & (at(1) + at(3) <= 1), parts)


def ratio(a, b) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def missing_fields(names: list[str]) -> Column:
    """Array of those named columns that are null or blank in a row."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "", F.lit(n)) for n in names)))


def preferred_point(valid, smoothed: tuple[str, str], raw: tuple[str, str]) -> Column:
    """struct<x,y>: the smoothed point if its row is valid and both coordinates are there, else the raw one."""
    sx, sy = map(F.col, smoothed)
    x, y = map(F.col, raw)
    use = F.coalesce(_col(valid), F.lit(False)) & sx.isNotNull() & sy.isNotNull()
    return F.struct(F.when(use, sx).otherwise(x).alias("x"), F.when(use, sy).otherwise(y).alias("y"))


def court_point(valid, smoothed: tuple[str, str], raw: tuple[str, str]) -> Column:
    """struct<x,y>: the smoothed point alone, null or not, if its row is valid; else the raw one."""
    use = F.coalesce(_col(valid), F.lit(False))
    return F.struct(*(F.when(use, F.col(s)).otherwise(F.col(r)).alias(n) for n, s, r in zip("xy", smoothed, raw)))


def clean_struct(c: Column, kind: str) -> Column:
    """A nested value of a declared type with null for every number in it that isn't finite."""
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

    def walk(v: Column, t) -> Column:
        if isinstance(t, (DoubleType, FloatType)):
            return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        if isinstance(t, StructType):
            return F.when(v.isNotNull(), F.struct(*(walk(v[f.name], f.dataType).alias(f.name) for f in t.fields)))
        if isinstance(t, ArrayType):
            return F.transform(v, lambda x: walk(x, t.elementType))
        if isinstance(t, MapType):
            return F.transform_values(v, lambda _, x: walk(x, t.valueType))
        return v

    return walk(c, StructType.fromDDL(f"v {kind}")["v"].dataType)


def corner_text(c) -> Column:
    """array<array<double>> of a text `x,y;x,y;x,y;x,y` of four points within -2 and 3; else null."""
    points = F.transform(F.split(_col(c), ";"), lambda p: F.transform(F.split(F.trim(p), ","), lambda v: F.trim(v).try_cast("double")))
    good = lambda p: (F.size(p) == 2) & F.forall(p, lambda v: F.coalesce(v.between(-2, 3), F.lit(False)))
    return F.when((F.size(points) == 4) & F.forall(points, good), points)
