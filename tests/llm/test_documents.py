"""The operators over documents against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute
import pytest
import regex

from courtflow.llm import bpe, common, jaccard_join, lm, media, packing, pii, quality, sketch

ODD = [None, "", "   ", "a", "A b", "a b", "x" * 30_000, "word " * 4000, "tie tie tie tie tie tie", "tie tie tie tie tie tie", "\u00a0\u2028é 日本 \U0001f600 \x00\x1f", "<|endoftext|> <unk> ▁x"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(800)]
    made = list(ODD)
    base = [r.choice(vocabulary) for _ in range(90)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(90)] = r.choice(vocabulary)
        made.append(" ".join(copy))
    made += [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(60)] + made[12:30]
    return list(enumerate(made))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "en", i % 3, "other", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, block int, score string, rank double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# ---- quality


def test_quality_learns_held_out_labels(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        good = i % 4 != 0
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w)))
        labels.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.fit_and_score(docs, labels).withColumn("held", quality.held_out()).collect()
    held = [x for x in got if x["held"]]
    assert held and all((x["score"] >= 0.3) == (x["doc_id"] % 4 != 0) for x in held)
    assert all((zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) == x["held"] for x in got)


def test_quality_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert len(got) == docs.count() and all(x["score"] == 0.5 for x in got) and set(got[0].asDict()) == set(docs.columns)
    some = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (5, 1), (999, 1)], "doc_id bigint, quality int")
    assert all(0 <= x["score"] <= 1 for x in quality.fit_and_score(docs.select("doc_id", "text"), some).collect())
    assert quality.fit_and_score(empty, some).collect() == []


def plain_features(text, bits):
    """Bucket -> value, by dictionaries and Python's integers."""
    import xxhash

    mask = (1 << 64) - 1
    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", text)

    def shape(t):
        if t.isdigit():
            return b"9"
        if not re.match(rb"[0-9A-Za-z_\x80-\xff]", t):
            return t[:4]
        if t.isupper():
            return b"XX" if len(t) > 1 else b"X"
        return b"Xx" if t[:1].isupper() else b"x"

    words = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
    shapes = [xxhash.xxh64_intdigest(shape(t), 7) for t in tokens]
    again = [k > 0 and words[k] == words[k - 1] for k in range(len(tokens))]
    words = [0x5851F42D4C957F2D if same else w for w, same in zip(words, again)]
    shapes = [0x5851F42D4C957F2D if same else w for w, same in zip(shapes, again)]
    grams = [g for codes in (words, shapes) for g in [*codes, *((a * 0x9E3779B97F4A7C15 + b) & mask for a, b in zip(codes, codes[1:]))]]
    counts = Counter(((g ^ g >> 31) * 0x9E3779B97F4A7C15 & mask) >> (64 - bits) for g in grams)
    return {b: (n / len(grams)) ** 0.5 for b, n in counts.items()}


def plain_ftrl(rows, p):
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "bias" else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1 if z[i] < 0 else 0.0)) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                g = error * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * w[i]
                n[i] += g * g
    return weight


def test_quality_against_plain_python(spark):
    """Features, updates and scores by dictionaries; the query's own fold and threshold."""
    import xxhash

    r = random.Random(4)
    made = [(i, " ".join(r.choice(["Good", "text", "10", "the", "THE", "a-b", "x!", "\u00e9t\u00e9", "...."]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    made += [(60, ""), (61, None), (62, "same same same")]
    labels = [(i, int((t or "").count("Good") > 2)) for i, t in made[:40]]
    p = quality.QualityParams(bits=12, epochs=3)
    docs, marked = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {x["doc_id"]: x["score"] for x in quality.fit_and_score(docs, marked, p).collect()}
    by = {i: (t or "").encode() for i, t in made}
    trained = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    trained.sort(key=lambda iy: xxhash.xxh64_intdigest(str(iy[0])))
    weight = plain_ftrl([(plain_features(by[i], p.bits), y) for i, y in trained], p)
    for i, text in by.items():
        want = 1 / (1 + np.exp(-sum(weight(b) * v for b, v in plain_features(text, p.bits).items()) - weight("bias")))
        assert abs(got[i] - want) < 2e-4, i


def test_quality_names_cannot_clash(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id bigint, text string, __text string, ___text string")
    row = quality.score(df, np.zeros((1 << 18) + 1, np.float32)).first()
    assert (row["doc_id"], row["__text"], row["___text"], row["score"]) == (1, "x", "y", 0.5)


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, ("good words here " if i % 2 else "### !! ") * 20 + f"ann{i}@mail.example.com", "mine", 7, 8) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, __score int, __spans int")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == set(range(1, 40, 2)) and all((r["score"], r["__score"], r["__spans"]) == ("mine", 7, 8) for r in kept)
    clean = corpus_pipeline.pii_stage(spark, docs, str(tmp_path)).collect()
    assert len(clean) == 40 and all("[email]" in r["text"] and r["__spans"] == 8 for r in clean)


def test_near_duplicate_names_cannot_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id bigint, text string, __id int, __hash int")
    assert [tuple(x) for x in jaccard_join.one_of_each(df).collect()] == [(1, "a b c d e f", 7, 8)]


def test_ftrl_is_sparse_and_deterministic():
    r = np.random.default_rng(0)
    rows = [(np.array([1 + k % 2, 5 + int(r.integers(50))], np.uint32), np.array([0.8, 0.6], np.float32), k % 2) for k in range(300)]
    p = quality.QualityParams(bits=8)
    a, b = quality.ftrl(rows, p), quality.ftrl(rows, p)
    assert (a == b).all() and a[2] > 0 > a[1] and (a[100:-1] == 0).all()


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "mail ann@mail.example.com or a@b.com_c@d.org, x@y, é@é.de", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 or 0000255.0.0.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 5500005555555559",
    "call +1 (826) 555-4081 or +4930 1234567 or 826-555-4081, +1 (843) 555-7672 170.106.4.4", "bob (at) mail (dot) com", "\U0001f600 é 5500005555555559 \U0001f600 z@q.io", "9" * 5000, "a@" * 3000, "+1" * 2000, "1." * 3000, "x" * 20_000 + "@example.com", None, "", "+ @ .",
    "call 826-555-4081 today", "version 4111111111111112", "1 " * 9000,
]


def test_pii_base_spans_and_additions(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL * 3)), "doc_id bigint, text string").withColumnRenamed("doc_id", "candidates")
    df = df.withColumnRenamed("candidates", "doc_id")
    model = pii.fit(df)
    got = {r["doc_id"]: r for r in pii.with_spans(df, model).withColumn("clean", pii.redacted(df["text"], pii.F.col("spans"))).collect()}
    assert len(got) == 3 * len(PERSONAL)
    added = 0
    for i, text in enumerate(PERSONAL * 3):
        base = [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"] if s["base"]]
        assert base == base_spans(text), text[:60]
        every = [(pii.KINDS.index(s["kind"]), s["start"]) for s in got[i]["spans"]]
        assert every == sorted(every)
        added += sum(not s["base"] for s in got[i]["spans"])
        if text:
            assert not any(text[a:b] in got[i]["clean"] for k, a, b in base if k == "email")
        else:
            assert got[i]["clean"] == text
    assert added  # the second of two cards in a row, for one
    assert not any(not s["base"] for s in got[PERSONAL.index("version 4111111111111112")]["spans"])


def test_pii_many_spans_in_one_text_and_clashing_names(spark):
    text = " ".join(f"u{i}@example.com 10.0.{i % 250}.{i % 99} card 4111 1111 1111 1111 \U0001f600" for i in range(4000))
    names = ["c_email_1", "__c_email_1", "__p_all", "spans", "base", "candidates"]
    df = spark.createDataFrame([(0, text, *range(6)), (1, None, *range(6))], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    found = pii.with_spans(df, pii.fit(df), out="found").withColumn("clean", pii.redacted(pii.F.col("text"), pii.F.col("found")))
    rows = {r["doc_id"]: r for r in found.collect()}
    spans = [(s["kind"], s["start"], s["end"]) for s in rows[0]["found"] if s["base"]]
    assert spans == base_spans(text) and len(spans) == 12_000
    clean, at = "", 0
    for s in sorted(rows[0]["found"], key=lambda s: s["start"]):
        if s["start"] >= at:
            clean += text[at : s["start"]] + f"[{s['kind']}]"
        at = max(at, s["end"])
    assert rows[0]["clean"] == clean + text[at:] and rows[1]["clean"] is None and rows[1]["found"] == []
    assert all(tuple(r[n] for n in names) == tuple(range(6)) for r in rows.values())


def test_pii_empty_table(empty):
    assert pii.with_spans(empty, pii.fit(empty)).collect() == []


def test_em_finds_reliable_labelers():
    r, counts = random.Random(0), Counter()
    for _ in range(20_000):
        y = r.random() < 0.4
        vote = lambda right: (1 if y else -1) if r.random() < right else (-1 if y else 1)
        counts["email", (vote(0.97), vote(0.9), vote(0.6), vote(0.8)), 0] += 1
    m = pii.fit_counts(counts)
    assert abs(m.prior["email"] - 0.4) < 0.05
    assert m.reliability["email"]["gazetteer"][0] > m.reliability["email"]["edges"][0] > m.reliability["email"]["context"][0]


# ---- near duplicates


def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (n := len(sets[i] & sets[j])) and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("params", [{}, {"region_rows": 16, "block_rows": 9, "pivots": 3}, {"region_rows": 10, "block_rows": 6, "pivots": 2, "split_rounds": 1}])
def test_jaccard_join_is_exact(docs, texts, params):
    got = jaccard_join.near_duplicates(docs, jaccard_join.JaccardParams(**params)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_jaccard_join_odd_tables(spark, empty):
    assert jaccard_join.near_duplicates(empty).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (9, "g h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r[0], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == Counter({(5, 2): 2, (2, 2): 1, (None, 2): 1, (None, None): 1, (9, 9): 1})
    kept = Counter(tuple(r) for r in jaccard_join.one_of_each(df.union(df.where("doc_id = 9"))).collect())
    assert kept == Counter([(2, "A b c d e f"), (None, "a b c d e f"), (None, None), (9, "g h")])


@pytest.mark.parametrize("rows", [200_000, 0])
def test_jaccard_join_broadcasts_no_rows_a_set(spark, monkeypatch, rows):
    sent, send = [], jaccard_join.F.broadcast
    monkeypatch.setattr(jaccard_join.F, "broadcast", lambda df: (sent.append(df.count()), send(df))[1])
    texts = [" ".join(f"{i}w{j}" for j in range(30)) + more for i in range(400) for more in ("", " more")]
    df = spark.createDataFrame([(None, "a b"), (None, texts[0]), *enumerate(texts), (7, texts[7])], "doc_id bigint, text string")
    got = jaccard_join.near_duplicates(df, jaccard_join.JaccardParams(broadcast_rows=rows)).where("doc_id is not null").select("doc_id", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter([(i, i - i % 2) for i in range(800)] + [(7, 6)])
    kept = jaccard_join.one_of_each(df, jaccard_join.JaccardParams(broadcast_rows=rows), broadcast_rows=rows).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, "a b"), (None, texts[0]), *((i, texts[i]) for i in range(0, 800, 2))])
    assert rows or max(sent, default=0) < 100


def test_bitmap_marks_each_position(spark):
    at = {0, 63, 64, 8191, 8192, 5 << 33, (5 << 33) + 8191, *random.Random(3).sample(range(1 << 20), 3000)}
    near = at | {x + 1 for x in at}
    pages = common.bitmap(spark.createDataFrame([(x,) for x in at], "p bigint"), "p")
    for rows in (50_000, 0):
        got = common.with_mark(spark.createDataFrame([(x,) for x in near], "x bigint"), common.F.col("x"), pages, "there", rows).collect()
        assert {r["x"] for r in got if r["there"]} == at and len(got) == len(near)


def test_jaccard_join_gives_a_row_a_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a)] * 3 + [(2, a + " more")] + [(5, b)] * 2 + [(5, a + " other"), (9, b + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == Counter({(1, 36, 1): 3, (2, 37, 1): 1, (5, 36, 5): 2, (5, 37, 1): 1, (9, 37, 5): 1})


def test_small_tables_take_few_files(spark, texts, monkeypatch):
    """Of the tables of the join only the documents' and the links' are written by as many tasks as a shuffle has, whatever its partitions."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    files, old = [], type(docs).checkpoint

    def counted(df, *args):
        files.append(df.rdd.getNumPartitions())
        return old(df, *args)

    monkeypatch.setattr(type(docs), "checkpoint", counted)
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == want
    assert len(files) > 10 and sorted(files)[-2:] == [24, 24] and max(sorted(files)[:-2]) <= 1


def test_region_join_recurses_exactly():
    r = random.Random(8)
    p = jaccard_join.JaccardParams(pivots=3)
    for _ in range(20):
        sets = [sorted(r.sample(range(40), r.randint(5, 30))) for _ in range(40)]
        for s in list(sets[:30]):
            t = set(s)
            t.discard(r.choice(s))
            sets.append(sorted(t | {r.randrange(40)}))
        s = jaccard_join.Sets([np.array(x, np.uint64) for x in sets], [len(x) for x in sets], 80)
        rows = [(i, x) for i, x in enumerate(sets)]
        root = list(range(len(sets)))
        for i, a in rows:
            for j, b in rows[:i]:
                if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
                    x, y = root[i], root[j]
                    root = [min(x, y) if v in (x, y) else v for v in root]
        assert jaccard_join.join_region(s, p).tolist() == root


def near_copies(n, seed, words=200, edits=8):
    """Texts that each differ from one text in up to so many words, so that pivots don't part them and many link with none."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(1, edits)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def test_region_that_pivots_do_not_part_is_compared_once(monkeypatch):
    texts = near_copies(300, 5)
    sets = [jaccard_join.shingles(t.encode(), common.BoundedCache(jaccard_join.xxhash.xxh64_intdigest, 50_000), 5) for t in texts]
    s, calls, against = jaccard_join.Sets(sets, [len(x) for x in sets], 80), [], jaccard_join.Sets.against
    monkeypatch.setattr(jaccard_join.Sets, "against", lambda self, i, others: (calls.append(i), against(self, i, others))[1])
    got = jaccard_join.join_region(s, jaccard_join.JaccardParams())
    assert got.tolist() == [root for _, _, root in brute_components(list(enumerate(texts)))]
    assert 30 < len(set(got.tolist())) < 300 and len(calls) <= len(texts) + 16
    calls.clear()
    assert (jaccard_join.join_region(s, jaccard_join.JaccardParams(), got) == got).all() and len(calls) <= len(texts) + 16


def test_large_region_that_pivots_do_not_part(spark):
    """Beside one that they part; both over the limit of a task."""
    texts = near_copies(120, 6) + [t for seed in range(7, 11) for t in near_copies(20, seed, 100, 4)]
    rows = [(i, t + " " + " ".join(f"s{k}" for k in range(8))) for i, t in enumerate(texts)]
    for params in ({"region_rows": 50, "block_rows": 40}, {"region_rows": 30, "block_rows": 25, "pivots": 6}):
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), jaccard_join.JaccardParams(**params)).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute_components(rows)


# ---- packing


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  \n", "x<|endoftext|>y <|endoftext| > <|endof", "  <|endoftext|>  tail  ", "<|endoftext|>" + "word " * 3000]


@pytest.mark.parametrize("special", [True, False])
def test_packing_whole(spark, texts, special):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)  # with special, the library as it is
    if not special:
        t.encode_special_tokens = True
    texts = [*texts, *enumerate(SPECIAL, len(texts))]
    docs = spark.createDataFrame([(i, x, 7, 7, 7) for i, x in texts], "doc_id bigint, text string, salt int, rank int, sequence_id int")
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    rows = packing.pack_documents(docs, path, P.PATTERN, 2048, special_tokens=special).collect()
    pieces = {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, ids in want.items():
        assert [(s, n) for _, s, n in sorted(pieces[i])] == packing.cut(len(ids), 2048)
    used, least = check_packed(rows, 2048), -(-sum(map(len, want.values())) // 2048)
    assert least <= used <= least + 1


def test_packing_odd_tables(spark, empty):
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []
    df = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (None, 0, 3), (2, 0, 10)], "doc_id bigint, piece int, length bigint")
    assert check_packed(packing.pack(df, 10).collect(), 10) == 3
    more = df.selectExpr("*", "'mine' AS salt", "5 AS rank", "6 AS before", "7 AS low")
    rows = packing.pack(more, 10).collect()
    assert check_packed(rows, 10) == 3 and all((r["salt"], r["rank"], r["before"], r["low"]) == ("mine", 5, 6, 7) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_all_and_never_adds_bins(seed):
    r = random.Random(seed)
    histogram = Counter(r.choice([r.randint(1, 100), 34, 51, 26]) for _ in range(300))
    first = packing.best_fit_decreasing(histogram, 100)
    best = packing.local_search(first, 100)
    for groups in (first, best):
        held = Counter()
        for content, bins in groups.items():
            assert packing.fill(content) <= 100
            for n, c in content:
                held[n] += c * bins
        assert held == histogram
    squares = lambda g: sum(packing.fill(c) ** 2 * n for c, n in g.items())
    assert sum(best.values()) <= sum(first.values()) and squares(best) >= squares(first)


def test_local_search_looks_beyond_the_emptiest_groups():
    r = random.Random(5)
    histogram = Counter(r.randint(200, 900) for _ in range(400))
    first = packing.best_fit_decreasing(histogram, 2048)
    narrow = packing.local_search(first, 2048, width=2, trials=0)
    wide = packing.local_search(first, 2048, width=2)
    squares = lambda g: sum(packing.fill(c) ** 2 * n for c, n in g.items())
    held = lambda g: sum((Counter({n: c * b for n, c in content}) for content, b in g.items()), Counter())
    assert squares(wide) > squares(narrow) >= squares(first) and held(wide) == histogram
    assert sum(wide.values()) <= sum(narrow.values())


def test_local_search_empties_bins():
    # best-fit decreasing leaves three bins of 7, 6 and 5; exchanges bring them to two of 9
    groups = Counter({((4, 1), (3, 1)): 1, ((3, 2),): 1, ((2, 1), (3, 1)): 1})
    best = packing.local_search(groups, 9)
    assert sum(best.values()) == 2


# ---- language model


def test_lm_scores(docs, texts, empty):
    trains = docs["doc_id"] % 7 != 2
    for order in (2, 3):
        p = lm.LmParams(order=order, prior=4.0)
        got = {r["doc_id"]: r for r in lm.score(docs, trains, p).collect()}
        counts = [Counter() for _ in range(order + 1)]
        seqs = {i: ["<s>", *words(t), None] for i, t in texts}
        for i, s in seqs.items():
            if i % 7 != 2:
                for n in range(1, order + 1):
                    counts[n].update(tuple(s[k : k + n]) for k in range(len(s) - n + 1))
        n_all = sum(c for g, c in counts[1].items() if g != ("<s>",))
        kinds = len(counts[1]) - 1

        def probability(history, word):
            if not history:
                return (counts[1][(word,)] + 1) / (n_all + kinds + 1)
            c = counts[len(history)][history]
            lower = probability(history[1:], word)
            return (counts[len(history) + 1][(*history, word)] + 4.0 * lower) / (c + 4.0)

        for i, s in seqs.items():
            want = sum(log10(probability(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
            base = sum(log10((counts[1][(w,)] + 1) / (n_all + kinds + 1)) for w in s[1:])
            r = got[i]
            assert abs(r["score"] - want) < 1e-6 * abs(want) and abs(r["base_score"] - base) < 1e-9 * abs(base)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trains"]) == (len(s) - 1, sum(counts[1][(w,)] > 0 for w in s[1:]), n_all, i % 7 != 2)
    assert lm.score(empty, empty["doc_id"] > 0).collect() == []


@pytest.mark.parametrize("partitions", [64, 200])
def test_lm_totals_do_not_depend_on_partitions(docs, texts, spark, partitions):
    rows = lambda: {r["doc_id"]: r for r in lm.score(docs, docs["doc_id"] % 7 != 2).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        want = rows()
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = rows()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n_all = sum(len(words(t)) + 1 for i, t in texts if i % 7 != 2)
    assert len(got) == len(want) == len(texts) and {r["train_tokens"] for r in got.values()} == {n_all}
    for i, r in got.items():
        assert abs(r["score"] - want[i]["score"]) < 1e-9 * abs(want[i]["score"]) and abs(r["base_score"] - want[i]["base_score"]) < 1e-9 * abs(want[i]["base_score"])


def test_lm_probabilities_sum_to_one():
    texts, trains = [b"a b a c", b"b a", b"a b c c b"], np.array([True, True, True])
    from courtflow.llm import exchange

    p = lm.LmParams(order=3, prior=2.0)

    def score(extra):
        every, flags = [*texts, extra], np.append(trains, False)
        asked = exchange.ask_table(lm.block_asks(0, every, flags, 2, p))
        answers = exchange.answer
        import pyarrow.compute as pc

        table = pa.concat_tables([answers(asked.filter(pc.equal(asked["shard"], s))) for s in set(asked["shard"].to_pylist())])
        return lm.block_scores(every, flags, lambda n: exchange.read_answers(table, n, 2), p)["score"][-1]

    # of a text's words up to some place, the next is one of a, b, c, the end or unknown; the score of "x y" less its end's is its prefix's
    prefix = b"a b"
    after = [score(prefix + b" " + w) for w in (b"a", b"b", b"c", b"zzz")]
    ends = [score(prefix + b" " + w + b" ") for w in (b"a", b"b", b"c", b"zzz")]
    assert after == ends and all(x < 0 for x in after)


# ---- media, byte-level BPE, sketches


def brute_feature(data):
    rows = [data[k : k + 576] for k in range(0, len(data), 576)]
    steps = sum(abs(a - b) for row in rows for a, b in zip(row, row[1:]))
    counts = [sum(x // 16 == k for x in data) for k in range(16)]
    return f"576x{len(rows)};sum={sum(data)};steps={steps};counts={','.join(map(str, counts))}"


def test_media_round_trip(docs, texts, empty):
    rows = media.text_media(docs).collect()
    by = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        data = (by[r["doc_id"]] or "").encode()
        full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert bytes(r["samples"]) == full and r["n_bytes"] == len(data) and r["feature"] == brute_feature(full)
        assert media.load(bytes(r["media"]), len(data)).tobytes() == full
        argb = media.vp8l.decode(bytes(r["media"]))
        assert b"".join(bytes([p >> 16 & 255, p >> 8 & 255, p & 255]) for p in argb.ravel().tolist()) == full
    assert media.text_media(empty).collect() == []


def test_the_media_query_goes_through_all_of_the_decoder(spark, tmp_path):
    """Documents that call for each transform; digests against hashlib and zlib."""
    from courtflow.llm import queries, vp8l

    r = random.Random(2)
    walk = "".join("".join(map(chr, p)) for p in zip(*([40 + (k * s) % 80 for k in range(1200)] for s in (1, 2, 3))))
    prose = " ".join(r.choice(["the", "of", "play", "court", "shuttle", "and"]) for _ in range(900))
    same = "".join(3 * chr(r.randint(33, 126)) for _ in range(1500))
    texts = [walk, prose, same, "ab " * 900, "short", "", None, "\u00e9\U0001f600" * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    used = set()
    for t in texts:
        names = ("undo_predictor", "cross_colour", "undo_palette", "_fast_pixels", "_items", "_resolved")
        originals = {f: getattr(vp8l, f) for f in names}
        data = media.store(media.padded((t or "").encode()))
        for f, g in originals.items():
            setattr(vp8l, f, lambda *x, f=f, g=g, **k: used.add(f) or g(*x, **k))
        try:
            media.load(data, len((t or "").encode()))
        finally:
            for f, g in originals.items():
                setattr(vp8l, f, g)
    assert used == {"undo_predictor", "cross_colour", "undo_palette", "_fast_pixels", "_items", "_resolved"}
    for row in queries.op7_media_columns(spark, str(tmp_path)).collect():
        data = (texts[row["doc_id"]] or "").encode()
        full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored = media.store(full)
        assert (row["n_bytes"], row["payload_bytes"], row["media_bytes"]) == (len(data), len(full), len(stored))
        assert row["payload_sha256"] == hashlib.sha256(full).hexdigest() and row["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(full[-32:]) and row["feature"] == brute_feature(full)


def test_media_of_long_payloads_is_one_image():
    data = bytes(range(256)) * 40_000
    stored = media.store(media.padded(data))
    assert stored.count(b"WEBPVP8L") == 1 and media.load(stored, len(data)).tobytes() == media.padded(data)


def test_media_of_texts_that_repeat_from_afar():
    """Pixels that come again as far on as the format's distances go (2**20, less 120 near pixels), and farther."""
    farthest, sizes = (1 << 20) - 120, {}
    for apart in (farthest, farthest + 1, 1_500_000):
        block = random.Random(5).randbytes(3 * 600)
        data = block + bytes(3 * (apart - 600)) + block
        stored = media.store(media.padded(data))
        assert media.load(stored, len(data)).tobytes() == media.padded(data)
        sizes[apart] = len(stored)
    assert sizes[farthest] + 1000 < sizes[farthest + 1]  # the reference is taken where there is one


def test_byte_bpe(docs, texts, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: i for i, x in enumerate(vocabulary)}, special_tokens={})
    by = dict(texts)
    for r in bpe.encode_decode(docs, path, P.PATTERN).collect():
        assert r["ids"] == enc.encode_ordinary(by[r["doc_id"]] or "") and bytes(r["decoded"]) == (by[r["doc_id"]] or "").encode() and r["n_tokens"] == len(r["ids"])
    for r in bpe.encode_decode(docs, path, P.PATTERN, digests_only=True).limit(5).collect():
        assert r["decoded_sha256"] == hashlib.sha256((by[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path, P.PATTERN).collect() == []


def test_byte_bpe_of_any_bytes_merges_by_rank():
    vocabulary = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"\xff\xff", b"bcbc"]
    tokenizer = bpe.ByteBpe(vocabulary, r"\S+|\s+")
    assert np.frombuffer(tokenizer.encode("abc bcbc abab"), "<u4").tolist() == [258, 32, 260, 32, 256, 256]
    assert regex.findall(r"\S+|\s+", "a b") == ["a", " ", "b"]


def test_sketches(docs, texts, empty):
    rows = {r["doc_id"]: r for r in sketch.fingerprints(docs, fraction=1.0).collect()}
    assert len(rows) == len(texts)

    def shingles(t):
        w = (t or "").lower().translate({i: " " for i in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    for k, (i, t) in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = rows[i]
        assert r["edited"] == edited and len(r["sketch"]) == len(shingles(t))
        for near, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = shingles(t), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else float(t == other))) < 1e-9
    assert sketch.fingerprints(empty).collect() == []


def test_sketch_scales_and_merges(docs, spark):
    full = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.select("doc_id", "text"), "text", "s", 1.0).collect()}
    part = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.select("doc_id", "text"), "text", "s", 0.25).collect()}
    limit = sketch.LOWEST + (1 << 62)
    assert all(part[i] == [h for h in full[i] if h < limit] for i in full)
    one = spark.createDataFrame([([[1, 3], [2, 3]],)], "s array<array<bigint>>")
    assert one.select(sketch.merged("s")).first()[0] == [1, 2, 3]


def test_sketch_error_at_the_production_fraction(docs, texts):
    exact = {r["doc_id"]: r for r in sketch.fingerprints(docs, fraction=1.0).collect()}
    rows, deviations = sketch.fingerprints(docs).collect(), []
    for r in rows:
        e = exact[r["doc_id"]]
        assert r["sketch"] == [h for h in e["sketch"] if h < sketch.LOWEST + (1 << 62)] and set(r["sketch"]) <= set(e["sketch"])
        either = len(set(e["sketch"]) | set(e["edited_sketch"]))
        if either >= 40:
            j = e["near_edited"]
            deviations.append((r["near_edited"] - j) / (max(j * (1 - j), 0.01) / (either / 4)) ** 0.5)
    assert len(deviations) > 50 and max(map(abs, deviations)) < 4.5 and sum(d * d for d in deviations) / len(deviations) < 2


def test_next_document_of_one_and_of_equal_ids(spark):
    one = spark.createDataFrame([(4, "a b c d e f")], "doc_id bigint, text string")
    r = sketch.fingerprints(one, 1.0).first()
    assert r["near_next"] == 1.0 and r["edited"] == "a b c " + "a b c"
    same = spark.createDataFrame([(1, "p q"), (1, "p q"), (1, "r s"), (None, "t u")], "doc_id bigint, text string")
    assert sketch.fingerprints(same).count() == 4


@pytest.mark.parametrize("blocks, shards", [(1, 1), (7, 3), (40, 30)])
def test_exchange_in_two_levels(spark, blocks, shards):
    from courtflow.llm import exchange

    r = np.random.default_rng(blocks)
    keys = [np.unique(r.integers(0, 1 << 16, 300).astype(np.uint64) << np.uint64(44)) for _ in range(blocks)]
    counts = [r.integers(0, 5, len(k)) for k in keys]
    total = Counter()
    for k, c in zip(keys, counts):
        for x, n in zip(k.tolist(), c.tolist()):
            total[x] += n
    for most in (0, 10**9):
        p = exchange.Plan(blocks, shards, most)
        assert p.two_levels == (most == 0)
        rows = [row for b in range(blocks) for space in (0, 2) for row in exchange.ask(b, space, keys[b], counts[b] * (space + 1), p.groups, bits=60, every=True)]
        asked = spark.createDataFrame(exchange.ask_table(rows))
        table = exchange.answers(asked, p, bits=60).toArrow()
        for b in range(blocks):
            mine = table.filter(pa.compute.equal(table["block"], b))
            for space in (0, 2):
                got, mass, kinds = exchange.read_answers(mine, space, p.groups)
                assert got.tolist() == [total[x] * (space + 1) for x in keys[b].tolist()]
                assert mass == sum(total.values()) * (space + 1) and kinds == sum(n > 0 for n in total.values())
