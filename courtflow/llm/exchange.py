"""Counting 64-bit keys over all documents, with the totals sent back to where the keys came from.

Documents lie in blocks of about equal bytes (by hash). A block sends each shard of the key range one packed row of its
sorted distinct keys and their counts; a shard adds up over all blocks and answers each with the totals in
the order asked, without the keys. So a block of any corpus learns exactly the corpus counts of the keys
it holds, in memory that depends on the sizes of a block and a shard only, and a key that is everywhere costs
no more than one entry a block.

Rows are blocks x shards. Where that would be too many, the exchange has two levels: blocks send to groups of shards, relays
(a group for a range of blocks) add up and send to the shards, and hand the answers back.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean, shuffle_partitions

ASK = "shard int, block int, keys binary, counts binary"
ANSWER = "shard int, block int, totals binary, mass bigint, kinds bigint"


@dataclass(frozen=True)
class Plan:
    """How many blocks and shards; over most_rows packed rows there are two levels."""

    blocks: int
    shards: int
    most_rows: int = 4_000_000

    @property
    def two_levels(self) -> bool:
        return self.blocks * self.shards > self.most_rows

    @property
    def groups(self) -> int:
        """What a block sends rows to: shards, or groups of them."""
        return -(-self.shards // self.each) if self.two_levels else self.shards

    @property
    def each(self) -> int:
        """Shards in a group."""
        return isqrt(self.shards - 1) + 1 if self.two_levels else 1

    @property
    def relays(self) -> int:
        """Of each group."""
        return isqrt(self.blocks - 1) + 1


def plan(docs: DataFrame, block_bytes: int, shard_bytes: int = 32 << 20, most_rows: int = 4_000_000) -> Plan:
    """For keyed docs: blocks and shards of about so many bytes of text, at least one a shuffle partition."""
    size, least = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], shuffle_partitions(docs.sparkSession)
    return Plan(max(least, -(-size // block_bytes)), max(least, -(-size // shard_bytes)), most_rows)


def block_of(plan: Plan) -> F.Column:
    """The block of a row (doc_id, text); rows of one doc_id go by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.blocks)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the least number of bytes that holds them all; the number comes first."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros((((len(data) - 1) // width), 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bounds(shards: int, low: int, high: int) -> np.ndarray:
    """The first key of each shard of low..high after the first."""
    return np.array([low + (high - low) * i // shards for i in range(1, shards)], np.uint64)


def ask(block: int, space: int, keys: np.ndarray, counts: np.ndarray, shards: int, bits: int = 64, every: bool = False, low: int = 0, high: int | None = None) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of ASK for sorted distinct keys of so many bits; spaces keep kinds of keys apart. every: also to shards
    of which the block has no key, so that it gets mass and kinds of the whole space."""
    cuts = [0, *np.searchsorted(keys, bounds(shards, low, 1 << bits if high is None else high)).tolist(), len(keys)]
    return [(space * shards + s, block, pack_sorted(keys[a:b]), pack(counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if every or b > a]


def ask_table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "block", "keys", "counts"])


def answer(table: pa.Table) -> pa.Table:
    """All rows of one shard in, a row of ANSWER for each out; mass: the sum of counts, kinds: keys with a count over 0."""
    asked = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    counts = np.concatenate([unpack(c) for c in table["counts"].to_pylist()])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(at, counts).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    packed = [pack(totals[at[a:b]]) for a, b in zip(cuts, cuts[1:])]
    n = len(asked)
    return pa.table(
        [table["shard"], table["block"], pa.array(packed, pa.binary()), pa.array([int(totals.sum())] * n, pa.int64()), pa.array([int((totals > 0).sum())] * n, pa.int64())],
        names=["shard", "block", "totals", "mass", "kinds"],
    )


def read_answers(table: pa.Table, space: int, shards: int) -> tuple[np.ndarray, int, int]:
    """Totals of one space in the order of its keys; the sums of mass and kinds over the shards that answered: of the whole space if the block asked every one."""
    rows = sorted((s, t, m, k) for s, t, m, k in zip(*(table[c].to_pylist() for c in ("shard", "totals", "mass", "kinds"))) if s // shards == space)
    totals = np.concatenate([unpack(t) for _, t, _, _ in rows]) if rows else np.empty(0, np.uint64)
    return totals.astype(np.int64), sum(r[2] for r in rows), sum(r[3] for r in rows)


def combine(table: pa.Table, plan: Plan, bits: int) -> pa.Table:
    """All rows of one relay in, its own rows to the shards of its group out."""
    group, relay = table["shard"][0].as_py(), table["relay"][0].as_py()
    keys, at = np.unique(np.concatenate([unpack_sorted(k) for k in table["keys"].to_pylist()]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([unpack(c) for c in table["counts"].to_pylist()]), len(keys)).astype(np.int64)
    low, high = (((group % plan.groups + k) << bits) // plan.groups for k in (0, 1))
    return ask_table(ask(relay, group, keys, counts, plan.each, every=True, low=low, high=high))


def spread(table: pa.Table, answers: pa.Table, plan: Plan) -> pa.Table:
    """A relay's rows and the answers of its shards in, a row of ANSWER for each of its rows out."""
    asked = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    totals, mass, kinds = read_answers(answers, table["shard"][0].as_py(), plan.each)
    cuts, n = np.cumsum([0, *map(len, asked)]), len(asked)
    packed = [pack(totals[at[a:b]]) for a, b in zip(cuts, cuts[1:])]
    return pa.table([table["shard"], table["block"], pa.array(packed, pa.binary()), pa.array([mass] * n, pa.int64()), pa.array([kinds] * n, pa.int64())], names=["shard", "block", "totals", "mass", "kinds"])


def answers(asked: DataFrame, plan: Plan, bits: int = 64) -> DataFrame:
    """Rows of ANSWER for rows of ASK that blocks sent to plan.groups."""
    if not plan.two_levels:
        return asked.groupBy("shard").applyInArrow(lean(answer), ANSWER)
    asked = checkpoint(asked).withColumn("relay", (F.col("shard") * plan.relays + F.col("block") % plan.relays).cast("int"))
    sent = asked.groupBy("relay").applyInArrow(lean(lambda t: combine(t, plan, bits)), ASK)
    back = sent.groupBy("shard").applyInArrow(lean(answer), ANSWER).select(F.col("shard").alias("from_shard"), F.col("block").alias("to_relay"), "totals", "mass", "kinds")
    return asked.groupBy("relay").cogroup(back.groupBy("to_relay")).applyInArrow(lean(lambda t, a: spread(t, a.rename_columns(["shard", "block", "totals", "mass", "kinds"]), plan)), ANSWER)
