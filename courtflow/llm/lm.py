"""Language-model scoring by a weighted backoff automaton over words.

Histories that occur in the training documents are the states; a word seen after a history is an arc, with
its smoothed log-probability; all else leaves by the state's failure arc, with its backoff weight, to the
next shorter history. The probability of a word after a history h of n words, Dirichlet-smoothed, is

    p(w | h) = (c(h w) + prior * p(w | h without its first word)) / (c(h) + prior)

down to (c(w) + 1) / (N + V + 1) without a history. One left-to-right traversal of a text carries the state and
adds the weights of the arcs it takes.

Counts cover all training documents and grow with them: `exchange` sums them by shards and sends each block of
documents the counts of just those n-grams that its texts hold. A block thus builds the slice of the automaton
that its texts can reach, and traverses it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import lean, shuffle_partitions

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BEGIN, _END = 0, 1  # word numbers; a text begins with the one and ends with the other
_BEGIN_KEY, _END_KEY = 0x5BD1E9955BD1E995, 0x165667B19E3779F9


@dataclass(frozen=True)
class LmParams:
    """block_bytes: text that one task scores at a time, at the least a text."""

    order: int = 2
    prior: float = 512.0
    block_bytes: int = 8 << 20


class Block:
    """The texts of one block as numbered words, and their distinct n-grams by order.

    keys[n]: sorted keys of the n-grams, n from 1; at[n]: for each position the index of the n-gram ending there, -1
    where the text is too short for it; first[n]: a position at which each n-gram ends.
    """

    def __init__(self, texts: list[bytes], trains: np.ndarray, order: int):
        class Numbers(dict):
            def __missing__(self, word):
                number = self[word] = len(self)
                return number

        numbers = Numbers({None: _BEGIN, True: _END})
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()
            part = np.empty(len(words) + 2, np.int32)
            part[0], part[-1] = _BEGIN, _END
            part[1:-1] = list(map(numbers.__getitem__, words))
            parts.append(part)
            sizes.append(len(part))
        seq = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.starts = np.cumsum([0, *sizes])
        hashes = np.array([_BEGIN_KEY, _END_KEY, *(xxhash.xxh64_intdigest(w) for w in list(numbers)[2:])], np.uint64)
        self.trains = np.repeat(np.asarray(trains, bool), sizes)
        place = np.arange(len(seq)) - np.repeat(self.starts[:-1], sizes)
        self.keys, self.at, self.first, self.counts = [None], [None], [None], [None]
        word = hashes[seq]
        key = word.copy()
        for n in range(1, order + 1):
            if n > 1:
                longer = np.zeros_like(key)
                mixed = key[:-1] * _MIX + word[1:]
                longer[1:] = mixed ^ (mixed >> np.uint64(29))
                key = longer
            there = np.flatnonzero(place >= n - 1)
            keys, first, at = np.unique(key[there], return_index=True, return_inverse=True)
            full = np.full(len(seq), -1, np.int32)
            full[there] = at
            self.keys.append(keys), self.at.append(full), self.first.append(there[first])
            self.counts.append(np.bincount(at, self.trains[there], len(keys)).astype(np.int64))


def _slice(block: Block, totals: list, words: int, kinds: int, p: LmParams) -> tuple[list, list, list, list, list, int]:
    """The part of the automaton that the block's texts can reach.

    Arcs are numbered through all orders; arc 0 is the root's for unknown words. A state is the history that an
    arc leads to. Returns by order the arc at each position (-1: none), and of each arc its weight, the state and its level
    after it, of each state its failure weight. State and arc numbers are the same; state 0 is the root.
    """
    offset, arcs_at, weight, fail, level = 1, [], [np.array([np.log10(1 / (words + kinds + 1))])], [np.zeros(1)], [np.zeros(1, np.int64)]
    probability = (totals[1] + 1) / (words + kinds + 1)
    for n in range(1, p.order + 1):
        if n > 1:
            first = block.first[n]
            before, shorter = block.at[n - 1][first - 1], block.at[n - 1][first]
            context = totals[n - 1][before]
            probability = (totals[n] + p.prior * lower[shorter]) / (context + p.prior)
        at = block.at[n]
        known = np.where(totals[n] > 0, np.arange(offset, offset + len(totals[n])), -1 if n > 1 else 0)
        arcs_at.append(np.where(at >= 0, known[at], -1))
        weight.append(np.log10(probability))
        fail.append(np.log10(p.prior / (totals[n] + p.prior)))
        level.append(np.full(len(totals[n]), min(n, p.order - 1)))
        lower, offset = probability, offset + len(totals[n])
    return arcs_at, np.concatenate(weight), np.concatenate(fail), np.concatenate(level), offset


def _traverse(arcs: list[list[int]], histories: list[list[int]], weight: list, fail: list, start: int, stop: int) -> float:
    """log10 probability of the words at start+1..stop-1. arcs[n][i]: the arc of the n+1-gram ending at i, or -1;
    histories[n][i]: the state of the last n words at i. The state is (level, position): the last `level` words read."""
    total, level, top = 0.0, min(1, len(arcs) - 1), len(arcs) - 1
    for i in range(start + 1, stop):
        while (arc := arcs[level][i]) < 0:  # failure: leave for the next shorter history
            total += fail[histories[level][i - 1]]
            level -= 1
        total += weight[arc]
        level = level + 1 if arc else 0
        if level > top:
            level = top
    return total


def block_scores(texts: list[bytes], trains: np.ndarray, totals_of, p: LmParams) -> dict[str, list]:
    """Columns of score() for one block. totals_of(space): as exchange.read_answers."""
    block = Block(texts, trains, p.order)
    answers = [None, *(totals_of(n) for n in range(1, p.order + 1))]
    totals = [None, *(a[0] for a in answers[1:])]
    begin = int(totals[1][np.searchsorted(block.keys[1], np.uint64(_BEGIN_KEY))]) if len(totals[1]) else 0
    words, kinds = answers[1][1] - begin, answers[1][2] - (begin > 0)
    arcs_at, weight, fail, _, _ = _slice(block, totals, words, kinds, p)
    lists = [a.tolist() for a in arcs_at]
    histories = [None, *lists[:-1]]
    weights, fails = weight.tolist(), fail.tolist()
    count = totals[1][block.at[1]]
    base = np.log10((count + 1) / (words + kinds + 1))
    out = {"n_tokens": [], "n_known": [], "train_tokens": [words] * len(texts), "base_score": [], "score": []}
    for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
        out["n_tokens"].append(b - a - 1)
        out["n_known"].append(int((count[a + 1 : b] > 0).sum()))
        out["base_score"].append(float(base[a + 1 : b].sum()))
        out["score"].append(_traverse(lists, histories, weights, fails, a, b))
    return out


def block_asks(block_no: int, texts: list[bytes], trains: np.ndarray, shards: int, p: LmParams) -> list:
    block = Block(texts, trains, p.order)
    # N and V are the mass and kinds of all words, so each block asks every shard of these
    return [row for n in range(1, p.order + 1) for row in exchange.ask(block_no, n, block.keys[n], block.counts[n], shards, every=n == 1)]


def score(docs: DataFrame, trains, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, trains, n_tokens, n_known, train_tokens, base_score, score), a row a row of docs.

    trains: boolean Column of docs: whether a row trains the model. Words are what white space (U+0009 to U+000D, space)
    parts, A-Z lower-cased; each text has one end token more, so a null or empty text has one token. Repeated rows train as often
    as they occur. base_score is the unigram log10 probability with add-one smoothing. Blocks are of equal bytes whatever the corpus, and go
    by doc_id and text, so neither a null nor a repeated doc_id gathers rows. An empty table gives an empty one.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    plan = exchange.plan(given, params.block_bytes)
    shards = plan.groups
    placed = given.withColumn("block", exchange.block_of(plan)).repartition(shuffle_partitions(docs.sparkSession), "block")
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def count(table: pa.Table) -> pa.Table:
        return exchange.ask_table(block_asks(table["block"][0].as_py(), table["text"].to_pylist(), table["trains"].to_numpy(), shards, params))

    @lean
    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = block_scores(table["text"].to_pylist(), table["trains"].to_numpy(), lambda n: exchange.read_answers(answers, n, shards), params)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([table["doc_id"], table["trains"], *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", "trains", *out])

    answers = exchange.answers(placed.groupBy("block").applyInArrow(count, exchange.ASK), plan)
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        apply, f"doc_id {kind}, trains boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
