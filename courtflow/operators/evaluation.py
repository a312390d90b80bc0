"""Predictions against references, samples for review, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tolerance_pairs(predictions: DataFrame, references: DataFrame, keys: list[str], tolerance: int, frame: str = "frame_id") -> DataFrame:
    """(keys, ref_id, pred_id, error): every pair at most `tolerance` frames apart, by a join on buckets of that width rather than on the key alone."""
    width = max(1, tolerance)
    p = predictions.select(*keys, F.col("id").alias("pred_id"), F.col(frame).alias("pf"), F.floor(F.col(frame) / width).alias("__b"))
    r = references.select(*keys, F.col("id").alias("ref_id"), F.col(frame).alias("rf"), F.explode(F.array(*((F.floor(F.col(frame) / width) + k) for k in (-1, 0, 1)))).alias("__b"))
    return p.join(r, [*keys, "__b"]).withColumn("error", F.abs(F.col("pf") - F.col("rf"))).where(F.col("error") <= tolerance).drop("__b")


def greedy_match(pairs: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """(keys, ref_id, pred_id, error): references in order of frame, each with the nearest prediction still free (of equals the first).

    What is free depends on what was taken, so pairs fold in order, on the JVM; references more than twice the tolerance
    apart can't want the same prediction, so each run of nearer ones folds for itself.
    """
    w = Window.partitionBy(*keys).orderBy("rf")
    far = F.coalesce(F.col("rf") - F.lag("rf").over(w) > 2 * tolerance, F.lit(False))
    parts = pairs.withColumn("__far", far).withColumn("__part", F.sum(F.col("__far").cast("int")).over(w))
    sorted_ = F.array_sort(F.collect_list(F.struct("rf", "ref_id", "error", "pf", "pred_id")))
    rows = parts.groupBy(*keys, "__part").agg(sorted_.alias("p"))
    t = dict(pairs.dtypes)
    kind = f"array<struct<ref_id:{t['ref_id']},pred_id:{t['pred_id']},error:{t['error']}>>"

    def fold(kept, p):
        busy = F.exists(kept, lambda m: (m["ref_id"] == p["ref_id"]) | (m["pred_id"] == p["pred_id"]))
        return F.when(busy, kept).otherwise(F.concat(kept, F.array(F.struct(p["ref_id"].alias("ref_id"), p["pred_id"].alias("pred_id"), p["error"].alias("error")))))

    return rows.select(*keys, F.explode(F.aggregate("p", F.array().cast(kind), fold)).alias("m")).select(*keys, "m.ref_id", "m.pred_id", "m.error")


def detection_metrics(predictions: DataFrame, references: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and mean error of a matching."""
    one = [predictions.agg(F.count("*").alias("predictions")), references.agg(F.count("*").alias("references")), matches.agg(F.count("*").alias("true_positives"), F.avg("error").alias("mean_error"), F.percentile("error", F.lit(0.5)).alias("median_error"))]
    d = reduce(lambda a, b: a.join(F.broadcast(b)), one)
    return d.withColumns({"false_positives": F.col("predictions") - F.col("true_positives"), "false_negatives": F.col("references") - F.col("true_positives"), "precision": F.try_divide("true_positives", "predictions"), "recall": F.try_divide("true_positives", "references")})


def macro_f1(pairs: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(class, support, precision, recall, f1) over the classes that occur in the truth; a null guess is a miss."""
    t = pairs.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), 1).otherwise(0)).alias("hits"))
    g = pairs.groupBy(F.col(guess).alias("class")).agg(F.count("*").alias("guessed"))
    d = t.join(g, "class", "left")
    precision, recall = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0)), F.col("hits") / F.col("support")
    d = d.withColumns({"precision": precision, "recall": recall})
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("class", "support", "precision", "recall", "f1")


def nearest_sample(targets: DataFrame, samples: DataFrame, keys: list[str], target: str = "target", frame: str = "frame_id") -> DataFrame:
    """targets with the nearest sample's frame more, of equals the earlier: from the last sample at or before and the first after, by one sort of both."""
    w = Window.partitionBy(*keys).orderBy("__f", "__kind")
    both = samples.select(*keys, F.col(frame).alias("__f"), F.lit(0).alias("__kind"), F.col(frame).alias("__s"), F.lit(None).cast("bigint").alias(target)).unionByName(
        targets.select(*keys, F.col(target).alias("__f"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__s"), F.col(target).cast("bigint").alias(target))
    )
    d = both.withColumns({"__p": F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.first("__s", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("__kind = 1")
    near = F.when(F.col("__n").isNull() | (F.col(target) - F.col("__p") <= F.col("__n") - F.col(target)), F.col("__p")).otherwise(F.col("__n"))
    return d.select(*keys, target, near.alias("nearest"))


def reason_histogram(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """(keys, histogram): `reason=n, ...` by reason; blanks don't count."""
    counts = rows.where(F.coalesce(F.trim(F.col(reason)), F.lit("")) != "").groupBy(*keys, reason).count()
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(reason, "count"))), lambda s: F.concat(s[reason], F.lit("="), s["count"].cast("string"))), ", ").alias("histogram"))


def stratified_sample(rows: DataFrame, strata: list[str], group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows in turn: strata by turns, in each the groups by turns, in each its rows in order."""
    inner = F.row_number().over(Window.partitionBy(*strata, group).orderBy(*order))
    d = rows.withColumn("__turn", inner)
    d = d.withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy("__turn", group)))
    return d.orderBy("__place", *strata, group, *order).limit(n).drop("__turn", "__place")


def null_aware(column: str) -> list[Column]:
    """Mean, root mean square and population deviation without nulls; the deviation needs two values."""
    c = F.col(column)
    return [F.avg(c).alias(f"{column}_mean"), F.sqrt(F.avg(c * c)).alias(f"{column}_rms"), F.when(F.count(c) >= 2, F.stddev_pop(c)).alias(f"{column}_std")]
