"""Readers, writers and contracts of the engine's tables and documents.

A missing path reads as no rows, cells of CSV are text, blanks are null, and writers put declared columns in declared order.
Paths go through Spark's file systems, so any store Spark reads will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

POSITIONS = "frame bigint, players struct<upper:struct<court:array<double>>,lower:struct<court:array<double>>>"
CALIBRATION = "video_stem string, unit string, corners array<array<double>>, homography array<array<double>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def text_schema(fields: list[str]) -> StructType:
    return StructType([StructField(f, StringType()) for f in fields])


def read_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """All columns text, blank cells null; a missing path has no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], text_schema(fields))
    return spark.read.csv(path, header=True, schema=text_schema(fields), enforceSchema=False, emptyValue="")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Declared columns only, in order; one that df lacks is blank, one that isn't declared is an error."""
    extra = [c for c in df.columns if c not in fields]
    if extra:
        raise ValueError(f"undeclared columns: {extra}")
    df.select(*(F.col(f).cast("string").alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A document, or with lines one a line. A missing path has no rows (and needs a schema)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(frame, upper_x, upper_y, lower_x, lower_y) of a log of one record a frame."""
    d = read_json(spark, path, POSITIONS, lines=True)
    at = lambda who, i: F.get(F.col(f"players.{who}.court"), F.lit(i))
    return d.select("frame", *(at(w, i).alias(f"{w}_{n}") for w in ("upper", "lower") for i, n in enumerate("xy")))


def main_view_intervals(timeline: DataFrame) -> DataFrame:
    """(segment_id, start, end) of a timeline document's main-view segments with some length; a missing id is its place, three digits."""
    s = timeline.select(F.posexplode("segments").alias("i", "s")).where((F.upper("s.label") == "MAIN_VIEW") & (F.col("s.end") > F.col("s.start")))
    return s.select(F.coalesce("s.segment_id", F.format_string("%03d", F.col("i") + 1)).alias("segment_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def with_calibration(rows: DataFrame, calibration: DataFrame, stem: str = "video_stem") -> DataFrame:
    """rows with their video's homography and corners, null where it has none. A row a video, so the join side is small and unique."""
    return rows.join(calibration.dropDuplicates(["video_stem"]).select(F.col("video_stem").alias(stem), "homography", "corners"), stem, "left")


def valid_calibrations(calibration: DataFrame) -> DataFrame:
    """Those in metres with four corners and a 3 x 3 matrix."""
    square = (F.size("homography") == 3) & F.forall("homography", lambda r: F.size(r) == 3)
    return calibration.where((F.col("unit") == "metre") & (F.size("corners") == 4) & square)


def trusted_frame_count(container: str, decoded: str):
    """The container's count where it is within 5 % (or one) of the decoded one, else that."""
    a, b = F.col(container), F.col(decoded)
    return F.when(F.abs(a - b) <= F.greatest(F.lit(1.0), b * 0.05), a).otherwise(b)


def listed_videos(rows: DataFrame, column: str = "output_path") -> DataFrame:
    """Rows of a clip list with video_path; those without a path go."""
    return rows.where(F.coalesce(F.trim(column), F.lit("")) != "").withColumnRenamed(column, "video_path")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """(video_path) of a list (CSV with output_path), a folder's .mp4 files in order, or a single file."""
    if path.endswith(".csv"):
        return listed_videos(read_csv(spark, path, ["output_path"])).select("video_path")
    p = spark._jvm.org.apache.hadoop.fs.Path(path if path.endswith(".mp4") else path.rstrip("/") + "/*.mp4")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return spark.createDataFrame([(f.getPath().toString(),) for f in found or []], "video_path string").orderBy("video_path")


def missing_columns(columns: list[str], required: list[str]) -> list[str]:
    """Those required columns that aren't there, in order."""
    return [c for c in required if c not in columns]


@dataclass(frozen=True)
class Contract:
    name: str
    status: str  # VALID, MISSING, EMPTY or INVALID
    detail: str = ""


def inspect_table(spark: SparkSession, name: str, path: str, required: list[str], min_rows: int = 1) -> Contract:
    """Whether a CSV is there, has its columns and at least min_rows rows; reads no more rows than that."""
    if not path_exists(spark, path):
        return Contract(name, "MISSING", path)
    d = spark.read.csv(path, header=True)
    lacks = missing_columns(d.columns, required)
    if lacks:
        return Contract(name, "INVALID", f"missing columns: {', '.join(lacks)}")
    found = d.limit(max(1, min_rows)).count()
    return Contract(name, "EMPTY" if not found else "INVALID", f"{found} rows") if found < min_rows else Contract(name, "VALID")
