"""URL filter: rules first, then a character language-model ratio. DataFrame operations only.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL a
log-likelihood difference by character; a URL is allowed if that is at or above a threshold calibrated on
labelled URLs that the models haven't seen. Characters are folded to a small alphabet, so the models have at
most len(ALPHABET) ** order entries however many URLs there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters, 0 for any digit, what marks parts of a URL, ~ for all else, ^ before the start, $ after the end
ALPHABET = LOWER + "0/.-_?=&#:%" + "~^$"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str  # starts with /
    verdict: str  # allow or block


@dataclass(frozen=True)
class UrlModelParams:
    """order: characters in the longest gram. prior: weight of the shorter context's estimate, in counts.
    broadcast_rows: up to so many grams the table of ratios is broadcast; a larger one is joined by a shuffle."""

    order: int = 4
    prior: float = 2.0
    broadcast_rows: int = 300_000
    bins: int = 4001


def url_host(url) -> F.Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def url_path(url) -> F.Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (host, path) with rule and rule_verdict more: of the rules that fit, the longest; null if none does."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return pages.withColumn("found", found).withColumns({"rule": F.col("found.rule"), "rule_verdict": F.col("found.verdict")}).drop("found")


def folded(host, path) -> F.Column:
    text = F.lower(F.concat(host, path))
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"[^a-z0/.\-_?=&#:%]", "~")


def grams(column, order: int) -> F.Column:
    """Every character of `^^^text$` after the padding, with the order-1 characters before it."""
    padded = F.concat(F.lit("^" * (order - 1)), column, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(column) + 1), lambda i: F.substring(padded, i, F.lit(order)))


def _ratios(counts: DataFrame, wanted: DataFrame, p: UrlModelParams) -> DataFrame:
    """(gram, ratio): log p(last character | those before), accepted less rejected, each an interpolation of all orders.

    counts: gram, allow, block. wanted: gram.
    """
    out, total = wanted, counts.agg(F.sum("allow").alias("allow0"), F.sum("block").alias("block0"))
    out = out.join(F.broadcast(total))  # one row
    for k in range(1, p.order + 1):
        shorter = counts.groupBy(F.right("gram", F.lit(k)).alias(f"gram{k}")).agg(F.sum("allow").alias(f"a{k}"), F.sum("block").alias(f"b{k}"))
        out = out.withColumn(f"gram{k}", F.right("gram", F.lit(k))).join(shorter, f"gram{k}", "left")
        if k > 1:
            context = counts.groupBy(F.left(F.right("gram", F.lit(k)), F.lit(k - 1)).alias(f"context{k}")).agg(F.sum("allow").alias(f"ca{k}"), F.sum("block").alias(f"cb{k}"))
            out = out.withColumn(f"context{k}", F.left(f"gram{k}", F.lit(k - 1))).join(context, f"context{k}", "left")

    def probability(count: str, context: str, zero: str):
        given = (F.coalesce(f"{count}1", F.lit(0)) + 1) / (F.coalesce(zero, F.lit(0)) + len(ALPHABET))
        for k in range(2, p.order + 1):
            given = (F.coalesce(f"{count}{k}", F.lit(0)) + p.prior * given) / (F.coalesce(f"{context}{k}", F.lit(0)) + p.prior)
        return given

    return out.select("gram", (F.log(probability("a", "ca", "allow0")) - F.log(probability("b", "cb", "block0"))).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule], params: UrlModelParams = UrlModelParams(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio), a row a row of pages.

    URLs that a rule decides are the labelled ones: four fifths, by hash of the URL, train the models, the rest sets
    the threshold (0 if it lacks a class). ratio is the length-normalised log-likelihood difference. A null URL, one
    without :// and an empty one have an empty host and path and are judged as the empty text. If a class has no
    labelled URL, the method allows all. Repeated rows are judged each for itself and count each; no other column is read, so none
    can clash. Texts are judged once each, and one that any share of the rows has doesn't skew the join with the rows.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    known = with_rules(parsed, rules).withColumn("folded", folded(F.col("host"), F.col("path")))
    texts = known.groupBy("folded").agg(
        F.sum(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allow"), F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("block"), F.count("*").alias("count")
    )
    texts = checkpoint(texts.withColumn("trains", F.crc32("folded") % 5 != 0))
    exploded = texts.drop("count").select("*", F.explode(grams(F.col("folded"), params.order)).alias("gram"))
    trained = "trains and allow + block > 0"
    counts = checkpoint(exploded.groupBy("gram").agg(*(F.sum(F.expr(f"if({trained}, {c}, 0)")).alias(c) for c in ("allow", "block"))))
    ratios = checkpoint(_ratios(counts.where("allow + block > 0"), counts.select("gram"), params))
    valued = exploded.join(F.broadcast(ratios), "gram") if ratios.count() <= params.broadcast_rows else join_hot(exploded, ratios, "gram")
    scored = checkpoint(valued.groupBy("folded", "allow", "block", "trains").agg(F.avg("ratio").alias("ratio")))
    threshold = calibrate(scored, params)
    by_text = scored.select("folded", "ratio")
    verdict = F.coalesce("rule_verdict", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return join_hot(known, by_text, "folded", counts=texts.select("folded", "count")).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")


def calibrate(scored: DataFrame, params: UrlModelParams) -> float:
    """The threshold of the best balanced accuracy on labelled URLs that didn't train; read off a histogram of fixed size."""
    bin_ = F.least(F.greatest(F.round(F.col("ratio") * 200), F.lit(-(params.bins // 2))), F.lit(params.bins // 2)).cast("int").alias("bin")
    labelled = scored.where("allow + block > 0")
    classes = labelled.where("trains").agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    if not classes[0] or not classes[1]:
        return float("-inf")
    rows = sorted(labelled.where("not trains").groupBy(bin_).agg(F.sum("allow"), F.sum("block")).collect())
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    best, missed, caught = (-1.0, 0.0, 0.0), 0, 0
    cuts = [rows[0][0] - 1] + [r[0] for r in rows]
    for low, (b, a, r) in zip(cuts, rows):
        at = (low + b) / 2
        best = max(best, ((allow - missed) / allow + caught / block, -abs(at), at))
        missed, caught = missed + a, caught + r
    return best[2] / 200
