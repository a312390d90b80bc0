"""Best-fit packing with swap-based local search, over the histogram of lengths.

Only lengths matter to a packing, and they are integers up to the capacity. So the documents are cut to
pieces and counted by length in Spark, and the driver packs the histogram: bins of equal content are one
group with a multiplicity, which keeps the state as small for a billion pieces as for a thousand. Best-fit
decreasing gives the first packing. The local search then takes two underfull bins at a time and moves a
document, or exchanges one for one or two for one, where that raises the sum of squared fills; bins
that run empty go. The result is a table of slots (length, ranks from-to, first sequence, offset, count), and each
piece finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import byte_alphabet
from .common import checkpoint, count_below, fresh, in_parts, keyed_text, let, shuffle_partitions

Content = tuple[tuple[int, int], ...]  # (length, count), longest first


class FileTokenizer:
    """ids of a byte-level BPE tokenizer file (tokenizers' JSON), by tiktoken's merging core: the same ids as
    Tokenizer.from_file(path).encode(text, add_special_tokens=False), much faster.

    Like that library, it takes the string of an added token in a text for that token; with special_tokens=False, which
    is that library's encode_special_tokens = True, such a string is ordinary text.
    """

    def __init__(self, path: str, pattern: str, special_tokens: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[flag] for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added and all(c in byte_of for c in token)}
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.find = regex.compile(pattern).finditer
        self.added = added if special_tokens else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.split and any(t in text for t in self.added):
            return b"".join(struct.pack("<I", self.added[part]) if k % 2 else self._ordinary(part) for k, part in enumerate(self.split(text)))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if len(text) <= 200_000:
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return b"".join(np.array(self.core._encode_single_piece(m.group().encode()), "<u4").tobytes() for m in self.find(text))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


@lru_cache(maxsize=2)
def file_tokenizer(path: str, pattern: str, special_tokens: bool) -> FileTokenizer:
    """One for a worker, which outlives a task."""
    return FileTokenizer(path, pattern, special_tokens)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids, end_id appended; a null or empty text is end_id alone."""

    def run(batches):
        tokenizer, end = file_tokenizer(tokenizer_path, pattern, special_tokens), struct.pack("<I", end_id)
        for batch in in_parts(batches, 1):
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = tokenizer.encode(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(row), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema.fieldNames())

    given = keyed_text(docs, id_col, text_col)
    schema = StructType.fromDDL(f"doc_id {given.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return given.mapInArrow(run, schema)


def fill(content: Content) -> int:
    return sum(n * c for n, c in content)


def _with(content: Content, put: Counter) -> Content:
    new = Counter(dict(content))
    new.update(put)
    return tuple(sorted(((n, c) for n, c in new.items() if c), reverse=True))


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Counter:
    """Groups (content -> number of bins) of best-fit decreasing, whole runs of equal lengths at a time."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        for room in sorted(r for r in by_room if r >= n):
            while left and by_room[room]:
                content, bins = by_room[room].popitem()
                each = min(room // n, left)  # the tightest bin that takes n stays so until it is full
                take = min(bins, left // each)
                if take < bins:
                    by_room[room][content] += bins - take
                by_room[room - each * n][_with(content, Counter({n: each}))] += take
                left -= take * each
            if not by_room[room]:
                del by_room[room]
            if not left:
                break
        each = capacity // n
        if left // each:
            by_room[capacity - each * n][((n, each),)] += left // each
        if left % each:
            by_room[capacity - left % each * n][((n, left % each),)] += 1
    return Counter({content: bins for groups in by_room.values() for content, bins in groups.items()})


def _best_exchange(give: Content, take: Content, room: int) -> tuple[int, Counter, Counter] | None:
    """What `give` hands over and gets back so that `take` gains most, up to room: (gain, over, back)."""
    best = None
    xs = [n for n, _ in take]
    pairs_x = sorted({a + b: (a, b) for i, a in enumerate(xs) for b in xs[i if take[i][1] > 1 else i + 1 :]}.items())
    ys = [n for n, _ in give]
    pairs_y = {a + b: (a, b) for i, a in enumerate(ys) for b in ys[i if give[i][1] > 1 else i + 1 :]}
    options = [(y, (y,), back) for y in ys for back in [(), *((x,) for x in xs), *(p for _, p in pairs_x)]]
    options += [(s, p, (x,)) for s, p in pairs_y.items() for x in xs] + [(s, p, ()) for s, p in pairs_y.items()]
    for out, over, back in options:
        gain = out - sum(back)
        if 0 < gain <= room and (best is None or (gain, -len(back)) > (best[0], -len(best[2]))):
            best = (gain, over, back)
            if gain == room and not back:
                break
    return best and (best[0], Counter(best[1]), Counter(best[2]))


class _Groups:
    """Groups of bins with their multiplicities, and the underfull ones in order of fill."""

    def __init__(self, groups: Counter, capacity: int):
        self.capacity, self.bins, self.under = capacity, Counter(), []
        for content, bins in groups.items():
            self.add(content, bins)

    def add(self, content: Content, bins: int) -> None:
        if not content or not bins:
            return
        now = self.bins[content] = self.bins[content] + bins
        if fill(content) < self.capacity:
            if now == bins:
                insort(self.under, (fill(content), content))
            elif not now:
                del self.under[bisect_left(self.under, (fill(content), content))]
        if not now:
            del self.bins[content]


def local_search(groups: Counter, capacity: int, width: int = 48, trials: int = 200_000) -> Counter:
    """Raise the sum of squared fills by moves and exchanges between underfull bins until none helps.

    First the `width` emptiest groups hand over documents, to any of the `width` fullest and emptiest underfull groups; where
    that no longer helps, every underfull group, to any other, until `trials` pairs of contents have been looked at there.
    A pair that can't exchange is remembered and not looked at again. Each step raises the sum, so it ends. Bins that run
    empty are dropped. A bin of capacity C has at most sqrt(2 C) lengths, which bounds the work for a pair.
    """
    g, barren, looked = _Groups(groups, capacity), set(), 0

    def step(givers, takers) -> bool:
        for room_give, give in givers:
            for room_take, take in takers:
                pairs = min(g.bins[give], g.bins[take]) if give != take else g.bins[give] // 2
                if not pairs or room_take < room_give or (give, take) in barren:
                    continue
                nonlocal looked
                looked += 1
                found = _best_exchange(give, take, capacity - room_take)
                if not found:
                    barren.add((give, take))
                    if looked > limit:
                        return False
                    continue
                _, over, back = found
                gone = Counter(over)
                gone.subtract(back)
                for content, bins in ((give, -pairs), (take, -pairs), (_with(take, gone), pairs), (_with(give, Counter({k: -v for k, v in gone.items()})), pairs)):
                    g.add(content, bins)
                return True
        return False

    while True:
        limit = float("inf")
        while step(g.under[:width], list(dict.fromkeys([*g.under[: -width - 1 : -1], *g.under[width::-1]]))):
            pass
        if len(g.under) <= width:
            return g.bins
        looked, limit = 0, trials
        if not step(list(g.under), g.under[::-1]):
            return g.bins
        trials -= looked


def pack_histogram(histogram: dict[int, int], capacity: int) -> Counter:
    return local_search(best_fit_decreasing(histogram, capacity), capacity)


def slots(groups: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, count): the places of one length in a group's bins.

    Ranks fill a bin's `count` places one after another, then the next bin's; sequences count from 0.
    """
    rank, sequence, out = Counter(), 0, []
    for content, bins in sorted(groups.items()):
        offset = 0
        for n, count in content:
            out.append((n, rank[n], rank[n] + bins * count, sequence, offset, count))
            rank[n] += bins * count
            offset += n * count
        sequence += bins
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (with doc_id, piece, length from 1 to capacity) with sequence_id and offset more (columns of those names are replaced).

    Each sequence is gapless from 0 and at most `capacity` long. Rows with equal doc_id and piece are packed
    each for itself. An empty table gives an empty table. To the driver go at most `capacity` counts; the
    table of slots has a bound from the capacity, not from the rows.
    """
    spark = pieces.sparkSession
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    if any(n < 1 or n > capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    own = fresh(pieces.columns, "__k_")
    salt, before, rank, low, places = (own + x for x in ("salt", "before", "rank", "low", "places"))
    found = slots(pack_histogram(histogram, capacity))
    table = spark.createDataFrame(found, "length bigint, low bigint, high bigint, first bigint, at bigint, count bigint")
    # a row a length: where its slots begin among the ranks, and the slots, both ascending
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "first", "at", "count"))).alias(places)).withColumn(low, F.transform(places, lambda x: x["low"]))
    salts = max(64, shuffle_partitions(spark))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counted = salted.groupBy("length", salt).count().select(
        "length", salt, (F.sum("count").over(Window.partitionBy("length").orderBy(salt)) - F.col("count")).alias(before)
    )
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = (
        salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
        .join(counted, ["length", salt])
        .withColumn(rank, F.col(rank) - 1 + F.col(before))
    )
    placed = ranked.join(F.broadcast(table), "length")  # at most `capacity` rows
    slot = let(F.struct(F.col(low).alias("low"), F.col(places).alias("places")), lambda v: F.get(v["places"], count_below(v["low"], F.col(rank), also_equal=True) - 1))

    def place(s):
        at = F.col(rank) - s["low"]
        return F.struct((s["first"] + F.floor(at / s["count"])).cast("bigint").alias("sequence_id"), (s["at"] + at % s["count"] * F.col("length")).alias("offset"))

    out = own + "out"
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.withColumn(out, let(slot, place)).select(*kept, f"{out}.sequence_id", f"{out}.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once to the shared checkpoint folder, as both passes need them.

    A row a piece of each row of docs, repeated rows each for itself; a null doc_id is kept. Only the id and the text are read,
    so no other column can clash.
    """
    return pack(checkpoint(token_pieces(docs, tokenizer_path, pattern, capacity, id_col=id_col, text_col=text_col, special_tokens=special_tokens)), capacity)
