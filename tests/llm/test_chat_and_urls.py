"""Reply trees and URL filters."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from courtflow.llm import chat, queries, url_filter

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\nb", "", None, "<|im_end|>\n", "é\U0001f600", "<" * 5 + "|" * 5, "x" * 20_000]


def read_back(paths):
    made = chat.format_paths(paths)
    return made.withColumns({"turns": chat.parse_turns(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()


def test_conversations_round_trip(spark):
    r = random.Random(0)
    rows, want = [], {}
    for c in range(40):
        turns = [(r.choice(["user", "assistant", "system", None, "odd\nrole\\"]), r.choice(NASTY)) for _ in range(r.choice([1, 2, 3, 17]))]
        want[c] = [(a or "", b or "") for a, b in turns]
        rows += [(c, 3 * k, a, b, 1) for k, (a, b) in enumerate(turns)]
    rows.append((None, None, None, None, 1))
    want[None] = [("", "")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, score int")
    got = {x["tree_id"]: x for x in read_back(chat.best_paths(chat.conversation_nodes(df)))}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for a, t in turns if a == "assistant")
        assert got[c]["formatted"].count(chat.START) == got[c]["formatted"].count("<|im_end|>") == len(turns)


def test_branches_are_ranked(spark):
    # 1 - 2 - 3, 1 - 4, 1 - 5 - 6; 7 - 8 with an unknown parent; 9 <-> 10 a circle with 11 below
    rows = [(1, None, 1.0), (2, 1, 1.0), (3, 2, 5.0), (4, 1, 9.0), (5, 1, 3.0), (6, 5, None), (7, 77, 0.5), (8, 7, 0.5), (9, 10, 1.0), (10, 9, 1.0), (11, 10, 50.0)]
    df = spark.createDataFrame([("t", n, p, "user", f"m{n}", s) for n, p, s in rows], "tree_id string, node_id bigint, parent_id bigint, role string, text string, score double")
    got = sorted((x["rank"], x["depth"], x["text"]) for x in chat.best_paths(df, per_tree=3).collect())
    assert got == [(1, 0, "m1"), (1, 1, "m4"), (2, 0, "m1"), (2, 1, "m2"), (2, 2, "m3"), (3, 0, "m1"), (3, 1, "m5"), (3, 2, "m6")]


def test_a_long_chain_and_an_empty_table(spark):
    df = spark.range(300).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    (x,) = read_back(chat.best_paths(chat.conversation_nodes(df)))
    assert x["loss"] == "".join(map(str, range(300))) and len(x["turns"]) == 300
    assert read_back(chat.best_paths(chat.conversation_nodes(df.where("false")))) == []


def test_repeated_turns_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    (x,) = read_back(chat.best_paths(chat.conversation_nodes(df)))
    assert [tuple(t) for t in x["turns"]] == [("assistant", "b"), ("user", "a"), ("user", "a")]


URLS = {
    "http://A.Example.COM/en/71?x#y": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "https://example.com/en/6": ("example.com", "/en/6", "com/en/", "block"),
    "x://net/de/": ("net", "/de/", "net/de/", "allow"), "http://b.example.net/de/8": ("b.example.net", "/de/8", "example.net/de/8", "block"),
    "http://xnet/de/": ("xnet", "/de/", None, None), "http://h.org?/es/": ("h.org", "", None, None), "http://q.org/es/": ("q.org", "/es/", "org/es/", "block"),
    "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "http://": ("", "", None, None), "a://É.com/en/#://b": ("É.com", "/en/", "com/en/", "block"),
    "http://" + "z" * 5000 + "/p" * 2000: ("z" * 5000, "/p" * 2000, None, None),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, "http://q.org/es/", "x", 1)], "page_id bigint, url string, host string, ratio int")
    got = [r.asDict() for r in url_filter.judge(df, queries.URL_RULES).collect()]
    assert len(got) == len(URLS) + 1
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = next(x for x in got if x["page_id"] == i and x["host"] == host and x["path"] == path)
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_model_tells_strange_hosts(spark, broadcast_rows):
    r = random.Random(2)
    word = lambda s: "".join(r.choice(s) for _ in range(8))
    rows = [f"http://{word('aeioulmn')}.net/de/{word('aeiou')}" for _ in range(300)] + [f"http://{word('xzqkj0')}.com/en/{word('xzq')}" for _ in range(300)]
    new = [f"http://{word('aeioulmn')}.info/{word('aeiou')}" for _ in range(40)] + [f"http://{word('xzqkj0')}.info/{word('xzq')}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows + new)), "page_id bigint, url string")
    got = {x["page_id"]: x for x in url_filter.judge(df, queries.URL_RULES, url_filter.UrlModelParams(broadcast_rows=broadcast_rows)).collect()}
    right = sum(got[600 + k]["verdict"] == ("allow" if k < 40 else "block") for k in range(80))
    assert right >= 76 and all(got[600 + k]["rule"] is None for k in range(80))


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in url_filter.judge(df, queries.URL_RULES).collect()} == {"allow"}
    assert url_filter.judge(df.where("false"), queries.URL_RULES).collect() == []


def test_conversation_minus_one(spark, tmp_path):
    spark.createDataFrame([(0, 0, "assistant", "hi")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, str(tmp_path)).collect()}
    said = f"user\n{queries.CONTROL}\nassistant\n{queries.CONTROL}\n"
    assert got[-1]["n_turns"] == 2 and got[-1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-1]["loss_sha256"] == hashlib.sha256(queries.CONTROL.encode()).hexdigest()
    assert got[0]["loss_chars"] == 2
