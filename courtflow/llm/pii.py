"""Personal data by weak supervision, by DataFrame operations only.

Patterns give candidate spans. Four labelers vote on each (for, against, or not at all): its format (regex and
check digits), a gazetteer (top-level domains, calling codes, issuer numbers, reserved networks), its context
(words before it) and its edges (characters beside it). Expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is for each kind, and so how likely each pattern is to be personal data. A
logistic span classifier is trained on those likelihoods. Both work on counts of vote patterns, whose number
has a bound (kinds x 3 ** labelers x shapes), so the corpus is only ever scanned and counted.

Candidates that meet a kind's definition exactly (`base`) always stay; of the others, those stay that the
classifier accepts and that overlap no base span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_below, fresh, let, running_max, running_sum

KINDS = ("email", "ip", "card", "phone")

#: What leads to the same matches as the plain definition, but in linear time: possessive repeats, and no second try
#: inside a run of characters whose first character already failed.
LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RELAXED = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?[(\[{{](?:at|AT)[)\]}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{{](?:dot|DOT)[)\]}}]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9.+-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: A cheap test that a text can have a match at all.
MAY_HOLD = {
    ("email", True): "@", ("email", False): r"[(\[{](?:at|AT)[)\]}]", ("ip", True): r"[0-9]\.[0-9]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    ("card", True): r"[0-9](?:[\x20-]?[0-9]){8}", ("card", False): r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}", ("phone", True): r"\+[0-9]", ("phone", False): r"[0-9][\x20.-][0-9]{4}",
}
#: Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "it", "uk", "at", "ch", "nl", "be", "pt", "pl", "eu", "us", "ca", "mx", "br", "ar", "au", "jp", "cn", "in")
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "91", "351", "352", "353", "358", "420")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|64[4-9]|65|62)"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|contacto)\b", "ip": r"\b(?:ip|ipv4|ipv6|host|server|client|address|adresse|direcci[oó]n|servidor)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta)\b", "phone": r"\b(?:phone|tel|telephone|call|fax|mobile|cell|telefon|anruf|téléphone|teléfono|llame)\b",
}
AGAINST = r"\b(?:version|release|isbn|issn|order|invoice|serial|sha1|sha256|md5|hash|token|uuid|commit)\b"
LABELERS = ("format", "gazetteer", "context", "edges")


def _digits(m) -> F.Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits) -> F.Column:
    """Whether the check digit of a string of digits is right."""
    back = F.reverse(digits)

    def digit(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _holds(kind: str, m) -> F.Column:
    """Whether a match of the strict pattern meets the kind's definition."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _gazetteer(kind: str, m) -> F.Column:
    if kind == "email":
        return F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
    if kind == "card":
        return F.rlike(_digits(m), F.lit(ISSUERS))
    if kind == "phone":
        return F.rlike(m, F.lit(r"^(?:\+(?:" + "|".join(CALLING_CODES) + r")[^0-9]|[^+])"))
    return ~F.rlike(m, F.lit(RESERVED))


def _sign(yes, no=None) -> F.Column:
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def _relaxed_format(kind: str, m) -> F.Column:
    if kind == "card":
        return _sign(luhn(_digits(m)))
    return F.when(F.startswith(m, F.lit("+")), 1).otherwise(0) if kind == "phone" else F.lit(1 if kind == "ip" else 0)


def _spans(df: DataFrame, text: str, kind: str, strict: bool, own: str) -> DataFrame:
    """df with column <own><kind>_<strict>: array<struct<kind,start,end,base,format,gazetteer,context,edges,shape>>, ascending."""
    name, pattern, may = f"{own}{kind}_{int(strict)}", (STRICT if strict else RELAXED)[kind], MAY_HOLD[kind, strict]
    t = F.col(text)
    may = F.contains(t, F.lit("@")) if may == "@" else F.rlike(t, F.lit(may))
    m, parts, items, ends = f"{name}_matches", f"{name}_parts", f"{name}_items", f"{name}_ends"
    df = df.withColumn(m, F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(parts, F.when(F.size(m) > 0, F.split(t, pattern, -1)))
    n = F.size(m)
    df = df.withColumn(items, F.when(n > 0, F.arrays_zip(F.col(m).alias("m"), F.slice(parts, 1, n).alias("left"), F.slice(parts, 2, n).alias("right"))))
    df = df.withColumn(ends, F.when(n > 0, running_sum(F.transform(items, lambda x: F.length(x["left"]) + F.length(x["m"])), n)))

    def span(x, end):
        match, before, after = x["m"], F.lower(F.right(x["left"], F.lit(48))), F.left(x["right"], F.lit(1))
        base = _holds(kind, match) if strict else F.lit(False)
        beside = F.rlike(F.concat(F.right(x["left"], F.lit(1)), F.lit(" "), after), F.lit(r"^[\p{L}\p{N}_]|[\p{L}\p{N}_]$"))
        return F.struct(
            F.lit(kind).alias("kind"), (end - F.length(match)).alias("start"), end.alias("end"), base.alias("base"),
            (_sign(base) if strict else _relaxed_format(kind, match)).alias("format"), _sign(_gazetteer(kind, match)).alias("gazetteer"),
            _sign(F.rlike(before, F.lit(CONTEXT[kind])), F.rlike(before, F.lit(AGAINST))).alias("context"), _sign(~beside).alias("edges"),
            F.when(F.length(_digits(match)) < 9, 0).when(F.length(_digits(match)) < 17, 1).otherwise(2).alias("shape"),
        )

    found = F.zip_with(items, ends, span)
    if strict and kind == "card":  # digits that are too few or too many are no candidate
        found = F.filter(found, lambda s: s["base"] | (s["end"] - s["start"]).between(13, 37))
    return df.withColumn(name, found).drop(m, parts, items, ends)


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "candidates") -> DataFrame:
    """docs with all candidate spans more, by kind, then start. A null or empty text has none. Offsets are code points, end exclusive.

    A column named `out` is replaced; no other name can clash. Work grows as n log n with a text's candidates.
    """
    df, own = docs, fresh(docs.columns, "__c_")
    keys = [(k, s) for k in KINDS for s in (True, False) if (k, s) in MAY_HOLD]
    for kind, strict in keys:
        df = _spans(df, text_col, kind, strict, own)
    names = [f"{own}{k}_{int(s)}" for k, s in keys]
    kind_of = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,format:int,gazetteer:int,context:int,edges:int,shape:int>>"
    return df.withColumn(out, F.concat(*(F.coalesce(F.col(n).cast(kind_of), F.array().cast(kind_of)) for n in names))).drop(*names)


@dataclass(frozen=True)
class PiiModel:
    """reliability[kind][labeler]: P(vote for | personal), P(against | personal), the same if not. weights: of the span classifier."""

    prior: dict[str, float]
    reliability: dict[str, dict[str, tuple[float, float, float, float]]]
    weights: dict[str, float]
    threshold: float = 0.5

    def probability(self, s) -> F.Column:
        """Of a candidate struct column, by the span classifier."""
        z = F.lit(self.weights.get("bias", 0.0))
        for k in KINDS:
            z = z + F.when(s["kind"] == k, self.weights.get(f"{k}", 0.0)).otherwise(0.0)
            for name in LABELERS:
                for v in (1, -1):
                    if w := self.weights.get(f"{k}:{name}:{v}"):
                        z = z + F.when((s["kind"] == k) & (s[name] == v), w).otherwise(0.0)
        for shape in (1, 2):
            z = z + F.when(s["shape"] == shape, self.weights.get(f"shape:{shape}", 0.0)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _names(kind: str, votes: tuple, shape: int) -> list[str]:
    return ["bias", kind, *(f"{kind}:{name}:{v}" for name, v in zip(LABELERS, votes) if v), *([f"shape:{shape}"] if shape else [])]


def fit_counts(counts: dict[tuple[str, tuple, int], int], rounds: int = 50, steps: int = 300) -> PiiModel:
    """EM over counted vote patterns {(kind, votes, shape): count}, then the classifier on the posteriors.

    Pseudo-counts say beforehand that a labeler is right rather than wrong, which settles which class is which, and
    personal data fails its own format (a wrong check digit, say) at most once in fifty.
    """
    prior, reliability, posterior = {}, {}, {}
    for kind in KINDS:
        own = {k: c for k, c in counts.items() if k[0] == kind}
        pi, rel = 0.5, {name: (0.6, 0.1, 0.1, 0.6) for name in LABELERS}
        for _ in range(rounds):
            sums = {name: [6.0, 1.0, 10.0, 1.0, 6.0, 10.0] for name in LABELERS}
            positive, total = 1.0, 2.0
            for key, c in own.items():
                yes, no = pi, 1 - pi
                for name, v in zip(LABELERS, key[1]):
                    r = rel[name]
                    yes *= r[0] if v == 1 else r[1] if v == -1 else max(1e-3, 1 - r[0] - r[1])
                    no *= r[2] if v == 1 else r[3] if v == -1 else max(1e-3, 1 - r[2] - r[3])
                q = posterior[key] = yes / (yes + no)
                positive, total = positive + c * q, total + c
                for name, v in zip(LABELERS, key[1]):
                    s = sums[name]
                    s[2], s[5] = s[2] + c * q, s[5] + c * (1 - q)
                    if v:
                        i = 0 if v == 1 else 1
                        s[i], s[3 + i] = s[i] + c * q, s[3 + i] + c * (1 - q)
            pi = min(0.99, max(0.01, positive / total))
            rel = {name: (s[0] / s[2], s[1] / s[2], s[3] / s[5], s[4] / s[5]) for name, s in sums.items()}
            ok, wrong, *rest = rel["format"]
            rel["format"] = (ok, min(wrong, 0.02), *rest)
        prior[kind], reliability[kind] = pi, rel
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    mass = sum(counts.values()) or 1
    for _ in range(steps):
        gradient: dict[str, float] = {}
        for (kind, votes, shape), c in counts.items():
            names = _names(kind, votes, shape)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(n, 0.0) for n in names))))) - posterior[kind, votes, shape]) * c / mass
            for n in names:
                gradient[n] = gradient.get(n, 0.0) + error
        for n, g in gradient.items():
            g += 1e-5 * weights.get(n, 0.0)
            squares[n] = squares.get(n, 0.0) + g * g
            weights[n] = weights.get(n, 0.0) - g / math.sqrt(squares[n] + 1e-12)
    return PiiModel(prior, reliability, weights)


def fit(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Scan all texts, count the vote patterns of all candidates, and fit."""
    candidates = with_candidates(docs.select(F.col(text_col).alias("text"))).select(F.explode("candidates").alias("s")).select("s.*")
    rows = candidates.groupBy("kind", *LABELERS, "shape").count().collect()  # at most 4 * 81 * 3
    return fit_counts({(r["kind"], tuple(r[name] for name in LABELERS), r["shape"]): r["count"] for r in rows})


def with_spans(docs: DataFrame, model: PiiModel, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with the found spans more: array<struct<kind,start,end,base>>, by kind as in KINDS, then start.

    A row a row of docs, repeated rows each for itself; a null, empty or clean text has an empty array. A column named `out` is
    replaced, all others stay. Equal spans can't occur twice within a kind; spans of two kinds may overlap, base ones
    always stay. An empty table gives an empty one. A text of any length is one row's work, n log n in its spans.
    """
    own = fresh([*docs.columns, out], "__p_")
    every, kept, ordered = (own + x for x in ("all", "kept", "ordered"))
    df = with_candidates(docs, text_col, every)
    base = F.array_sort(F.transform(F.filter(every, lambda s: s["base"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def chosen(v):
        """v: all candidates; starts of the base spans, ascending; how far the base spans reach that start no later."""

        def added(s):
            clear = F.coalesce(F.get(v["reach"], count_below(v["starts"], s["end"]) - 1) <= s["start"], F.lit(True))
            return ~s["base"] & (model.probability(s) >= model.threshold) & clear

        return F.filter(v["all"], lambda s: s["base"] | added(s))

    def bound(b):
        return let(F.struct(F.col(every).alias("all"), F.transform(b, lambda x: x["start"]).alias("starts"), running_max(F.transform(b, lambda x: x["end"])).alias("reach")), chosen)

    df = df.withColumn(kept, F.when(F.size(every) > 0, let(base, bound)).otherwise(F.col(every)))
    in_order = F.flatten(F.array(*(F.array_sort(F.transform(F.filter(kept, _of(k)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))) for k in KINDS)))
    df = df.withColumn(ordered, F.when(F.size(kept) > 0, in_order))
    kind_of = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return df.withColumn(out, F.coalesce(spans.cast(kind_of), F.array().cast(kind_of))).drop(every, kept, ordered)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def count_of(spans, kind: str) -> F.Column:
    return F.size(F.filter(spans, _of(kind))).cast("bigint")


def spans_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text, spans, block: int = 4096) -> F.Column:
    """The text with each span replaced by [kind]; overlapping spans are joined under the first one's kind.

    The text is cut to blocks of so many code points, and each block finds its own spans by bisection, so that no
    step goes through the whole text for a single span.
    """
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}+"), F.lit(0))

    def of_block(piece, i, s, starts, reach):
        at = i * block
        # spans of this block: from the first that reaches into it to the last that starts in it
        first, after = count_below(reach, at.cast("bigint"), also_equal=True), count_below(starts, at + F.length(piece))

        def part(k):
            done = F.when(k > 0, F.get(reach, k - 1)).otherwise(F.lit(0).cast("bigint"))  # up to here the text is out
            begin, fresh_ = F.greatest(done, at.cast("bigint")), F.get(starts, k)
            gap = F.substring(piece, (begin - at + 1).cast("int"), F.greatest(fresh_ - begin, F.lit(0).cast("bigint")).cast("int"))
            label = F.when((fresh_ >= done) & (fresh_ >= at), F.concat(F.lit("["), F.get(s, k)["kind"], F.lit("]"))).otherwise("")
            return F.concat(gap, label)

        parts = F.when(after > first, F.array_join(F.transform(F.sequence(first, after - 1), part), "")).otherwise("")
        last = F.greatest(F.when(after > 0, F.get(reach, after - 1)).otherwise(F.lit(0).cast("bigint")), at.cast("bigint"))
        return F.concat(parts, F.substring(piece, (last - at + 1).cast("int"), F.length(piece)))

    def whole(s):
        spans_ = F.struct(s.alias("s"), F.transform(s, lambda x: x["start"]).alias("starts"), running_max(F.transform(s, lambda x: x["end"])).alias("reach"))
        return let(spans_, lambda v: F.array_join(F.transform(blocks, lambda p, i: of_block(p, i, v["s"], v["starts"], v["reach"])), ""))

    return F.when(F.size(spans) > 0, let(by_start, whole)).otherwise(text)
