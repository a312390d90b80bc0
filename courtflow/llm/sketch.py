"""Document fingerprints: a threshold-scaled sketch. DataFrame operations only.

A sketch keeps every distinct hash of a text's five-word shingles that lies below a fixed fraction of the hash
range. So it grows with the text, the sketch of a union is the union of sketches, and the share of one
sketch that another holds estimates containment, also between very unequal documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keyed_text, shuffle_partitions

WIDTH = 5
LOWEST = -(1 << 63)


def words(text) -> F.Column:
    """Lower-cased words; white space is U+0009 to U+000D and the space."""
    return F.array_remove(F.split(F.lower(text), "[ \\x09-\\x0D]+"), "")


def with_sketch(df: DataFrame, text_col: str, out: str, fraction: float = 1 / 4) -> DataFrame:
    """df with the sketch of a text column more: array<bigint>, ascending. Null and empty texts have an empty one; a text
    of one to four words has its whole sequence as the only shingle. A column named `out` is replaced."""
    highest = LOWEST + int(fraction * (1 << 64)) - 1
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    own = fresh([*df.columns, out], "__s_")
    w, h, h2, h4 = (f"{own}{k}" for k in range(4))
    n = F.size(h)
    return (
        df.withColumn(w, words(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(h2, F.when(n >= WIDTH, pair(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1))))
        .withColumn(h4, pair(F.slice(h2, 1, n - 3), F.slice(h2, 3, n - 3)))
        .withColumn(out, F.when(n >= WIDTH, pair(F.slice(h4, 1, n - 4), F.slice(h, 5, n - 4))).when(n > 0, F.array(F.xxhash64(h, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
        .withColumn(out, F.array_sort(F.array_distinct(F.filter(out, lambda x: x <= F.lit(highest)))))
        .drop(w, h, h2, h4)
    )


def fingerprint(sketch) -> F.Column:
    """The hashes in hexadecimal, 16 digits each."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def resemblance(a, b, equal) -> F.Column:
    """Estimated Jaccard similarity of two sketches; where both are empty, 1 if `equal` (of the texts), else 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.when(equal, 1.0).otherwise(0.0))


def containment(a, b) -> F.Column:
    """Estimated share of a's shingles that b holds; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches) -> F.Column:
    """Sketch of the union of documents, from an array of sketches."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def _ranges(docs: DataFrame, parts: int) -> F.Column:
    """The number of the doc_id's range, of about equal ranges, found in two steps over literal bounds."""
    probabilities = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, probabilities)), F.lit(20 * parts))).first()[0] if probabilities else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    i = F.greatest(F.size(F.filter(F.array(*(F.lit(b[0]) for b in blocks)), lambda b: b <= F.col("doc_id"))) - 1, F.lit(0))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), i + 1)
    return F.coalesce(i * step + F.size(F.filter(fine, lambda b: b <= F.col("doc_id"))), F.lit(0))


def with_next(docs: DataFrame, parts: int, more=lambda df: df) -> DataFrame:
    """docs (doc_id, text, and what `more` adds from the text) with next_<c> of each column but doc_id more: of the row after it
    by doc_id, then hash of the text; after the last row comes the first.

    Rows go to ranges of doc_id, and each range gets a copy of the next one's first row, so no task holds all rows.
    A null doc_id comes first. `more` is applied once a row, after the exchange, which carries texts only.
    """
    spark = docs.sparkSession
    placed = docs.select("doc_id", "text", _ranges(docs, parts).alias("range"), F.xxhash64("text").alias("tie"))
    firsts = placed.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy("range").collect()  # at most `parts` rows
    # each range's first row goes to the range before it, too; the first range's to the last
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = spark.createDataFrame([(r["range"], r["first"]["doc_id"], r["first"]["tie"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)], f"own int, head_id {kind}, head_tie bigint, to int")
    fits = (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    copied = placed.join(F.broadcast(heads), fits).groupBy("to").agg(F.min(F.struct("doc_id", "tie", "text")).alias("h"))
    both = placed.withColumn("copied", F.lit(0)).unionByName(copied.select("h.*", F.col("to").alias("range"), F.lit(1).alias("copied")))
    by = Window.partitionBy("range").orderBy("copied", F.asc_nulls_first("doc_id"), "tie")
    dealt = more(both.repartition("range"))
    carried = [c for c in dealt.columns if c not in ("doc_id", "range", "tie", "copied")]
    return dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in carried}).where("copied = 0").drop("range", "tie", "copied")


def fingerprints(docs: DataFrame, fraction: float = 1 / 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, edited, sketch, edited_sketch, near_edited, near_next, held_by_edited), a row a row of docs.

    edited: the last floor(n/2) code points replaced by the first as many of the next document's text, or all
    it has. Of a single document the next one is itself. A null text is empty. Rows with equal doc_id go by the hash of their
    texts, equal rows follow one another; a null doc_id comes first. Very long texts are sketched whole. An empty table gives an empty one.
    The error of a likeness J of texts with n shingles between them is about sqrt(J (1 - J) / (n fraction)).
    """
    given = keyed_text(docs, id_col, text_col)
    paired = with_next(given, max(16, 2 * shuffle_partitions(docs.sparkSession)), lambda df: with_sketch(df, "text", "sketch", fraction))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = with_sketch(paired.withColumn("edited", edited), "edited", "edited_sketch", fraction)
    return out.select(
        "doc_id", "text", "edited", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
