"""Every registered query over the smallest tables: its columns, its rows, and its SQL where there is one."""

import zlib

import duckdb
import pytest

from courtflow.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], 3: ["doc_id", "n_shingles", "component_id"],
    4: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], 5: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    6: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], 7: ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    8: ["page_id", "host", "path", "rule", "verdict"], 9: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 10: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[int(name[2:].split("_")[0])])] == COLUMNS[int(name[2:].split("_")[0])]
    rows = got.toPandas()
    assert len(rows) >= 20
    if name in queries.ORACLE_SQL:
        want = con.sql(queries.ORACLE_SQL[name]).df()[got.columns]
        plain = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert plain(rows) == plain(want)


def test_held_out_folds(spark):
    for r in queries.op1_quality_classifier(spark, SF).limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    for r in queries.op6_lm_scoring(spark, SF).limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
