"""Match metadata: validation and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce


def metadata_errors(matches: DataFrame, required: list[str]) -> DataFrame:
    """(match_id, error), a row a fault: required fields that are blank, ids that occur again, years that aren't digits, frame rates that are neither positive nor unknown."""
    errors = F.transform(coerce.missing_fields(required), lambda n: F.concat(F.lit("missing "), n))
    year, fps = F.coalesce(F.col("year"), F.lit("")), F.coalesce(F.trim(F.col("fps")), F.lit(""))
    year_bad = F.when((year != "") & ~F.rlike(year, F.lit("^[0-9]+$")), F.lit("year is not digits"))
    fps_bad = F.when((F.lower(fps) != "unknown") & (F.coalesce(coerce.finite(fps), F.lit(0.0)) <= 0), F.lit("fps is not positive"))
    own = matches.select("match_id", F.explode(F.concat(errors, F.array_compact(F.array(year_bad, fps_bad)))).alias("error"))
    again = matches.groupBy("match_id").count().where("count > 1").select("match_id", F.lit("duplicate match_id").alias("error"))
    return own.unionByName(again)


def register(matches: DataFrame, new: DataFrame) -> DataFrame:
    """matches and those of new whose match_id isn't there yet."""
    return matches.unionByName(new.join(matches.select("match_id"), "match_id", "left_anti"), allowMissingColumns=True)


def review_template(rallies: DataFrame, fields: list[str]) -> DataFrame:
    """A rally table's declared fields with the columns that a reviewer fills in, all pending."""
    blank = {n: F.lit("") for n in ("corrected_start_time", "corrected_end_time", "review_notes")}
    return rallies.select(*fields).withColumns({"review_status": F.lit("pending"), **blank})


def batch_status(runs: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """(keys, runs, failed, exit_code): 2 where any run failed."""
    d = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"))
    return d.withColumn("exit_code", F.when(F.col("failed") > 0, 2).otherwise(0))


def stage_list(stages: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, stages): a run's stages in order as one text."""
    each = F.sort_array(F.collect_list(F.struct(order, text)))
    return stages.groupBy(*keys).agg(F.array_join(F.transform(each, lambda s: s[text]), " ").alias("stages"))


def existing(declared: list[str], there: Column) -> Column:
    """The declared output files that are there, in declared order."""
    return F.filter(F.array(*map(F.lit, declared)), lambda f: F.array_contains(there, f))
