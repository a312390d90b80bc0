"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir. Without it, a local session (tests) gets a folder of its own, and any other is an error:
    executors of a cluster can't read the driver's temporary folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="courtflow-checkpoint-"))


def checkpoint(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors. most: rows of df at most, if known; see `gathered`."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if most is None else gathered(df, most)).checkpoint()


def gathered(df: DataFrame, most: int, rows: int = 10_000) -> DataFrame:
    """df, of at most so many rows, in one partition for each 10,000 of them where that is fewer than a shuffle makes. Every partition of a
    checkpoint is a file, and for each file in a local folder Hadoop starts processes (chmod), which until they run share the executor's memory."""
    parts = max(1, -(-most // rows))
    return df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df


def forget(*tables: DataFrame) -> None:
    """Delete the files of checkpointed tables that nothing will read again."""
    for df in tables:
        found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if found.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df (checkpointed, of a few short columns) marked for a broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


_PAGE_BITS = 13


def bitmap(positions: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(page, words) of a column of bigints that aren't null: a bit each, in pages of 8,192 of which only those with any are there. most: rows of positions at most."""
    at = F.col(column)
    words = positions.groupBy(F.shiftright(at, _PAGE_BITS).alias("page"), F.shiftright(at, 6).bitwiseAND(127).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))).alias("bits"))
    pages = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return checkpoint(pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.element_at("words", i), F.lit(0).cast("bigint"))).alias("words")), most)


def with_mark(df: DataFrame, at: F.Column, pages: DataFrame, name: str, rows: int = 50_000) -> DataFrame:
    """df with a boolean more: whether bit `at` is set in pages of `bitmap`, which are broadcast up to so many (1 kB each)."""
    page, words = fresh(df.columns, "__page"), fresh(df.columns, "__words")
    found = df.withColumn(page, F.shiftright(at, _PAGE_BITS)).join(sized(pages.select(F.col("page").alias(page), F.col("words").alias(words)), rows), page, "left")
    word = F.get(F.col(words), F.shiftright(at, 6).bitwiseAND(127).cast("int"))
    mark = F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return found.withColumn(name, F.coalesce(mark, F.lit(False))).drop(page, words)


def part_by_keys(df: DataFrame, keys: DataFrame, on: list[str], rows: int = 200_000, most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose `on` are in keys (checkpointed, only these columns), and the others; nulls are in none. Up to so many keys are broadcast; of more
    only a bit for a hash of each (16 bits a key, at most most_bits), and rows of df that have a bit set are joined by a shuffle."""
    if (count := keys.count()) <= rows:
        few = F.broadcast(keys)
        return df.join(few, on, "left_semi"), df.join(few, on, "left_anti")
    at, maybe = F.pmod(F.xxhash64(*on), F.lit(min(16 * count, most_bits))), fresh(df.columns, "__maybe")
    marked = with_mark(df, at, bitmap(keys.select(at.alias("at")), "at", count), maybe)
    may = marked.where(maybe).drop(maybe)
    return may.join(keys, on, "left_semi"), marked.where(~F.col(maybe)).drop(maybe).unionByName(may.join(keys, on, "left_anti"))


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, least: int = 10_000, most: int = 100_000) -> DataFrame:
    """left.join(right, key, how) for a right table with one row a key, where a key may hold any share of left's rows.

    Keys of over max(least, rows / most) rows are at most `most`, whatever the tables, so their rows of right are
    broadcast; all other keys are joined by a shuffle that no key can skew. how: inner or left. counts: (key, count) of
    left, if at hand.
    """
    counts = left.groupBy(key).count() if counts is None else counts
    rows, top = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    limit = max(least, rows // most)
    if top <= limit:
        return left.join(right, key, how)
    hot = F.broadcast(checkpoint(counts.where((F.col("count") > limit) & F.col(key).isNotNull()).select(key)))
    few = F.broadcast(checkpoint(right.join(hot, key, "left_semi")))
    return left.join(hot, key, "left_anti").join(right, key, how).unionByName(left.join(hot, key, "left_semi").join(few, key, how))


def fresh(columns, name: str) -> str:
    """The name, with as many _ before it as it takes that no column's name begins with it (whatever its case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def let(value, function) -> F.Column:
    """function(value), where value is computed once: the optimizer may write a column's expression out wherever the column
    is named, also inside the lambdas of higher-order functions, which would compute it once an element."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _doubling(n) -> F.Column:
    return F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _scan(values, kind: str, join, n) -> F.Column:
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    start = values.cast(f"array<{kind}>")
    return F.aggregate(_doubling(F.size(values) if n is None else n), start, lambda a, k: F.transform(a, lambda x, i: F.when(i >= step(k), join(x, F.get(a, i - step(k)))).otherwise(x)).cast(f"array<{kind}>"))


def running_sum(values, n=None) -> F.Column:
    """Sums of an array's first 1, 2, ... n elements, in n log n steps. n: its size, if at hand."""
    return _scan(values, "bigint", lambda x, y: x + y, n)


def running_max(values, n=None) -> F.Column:
    """The greatest of an array's first 1, 2, ... n elements, in n log n steps."""
    return _scan(values, "bigint", lambda x, y: F.greatest(x, y), n)


def count_below(ascending, value, also_equal: bool = False) -> F.Column:
    """How many elements of an ascending array are less than (or equal to) a value, by bisection. ascending should be bound by `let`."""
    n = F.size(ascending)
    powers = F.when(n > 0, F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(low, k):
        next_ = low + F.call_function("shiftleft", F.lit(1), k)
        at = F.get(ascending, next_ - 1)
        return F.when((next_ <= n) & ((at <= value) if also_equal else (at < value)), next_).otherwise(low)

    return F.aggregate(powers, F.lit(0), step)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc32(column) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text) under fixed names; a null text is empty. Other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class BoundedCache(dict):
    """Memo of a pure function of a str or bytes; keys of over `longest` aren't kept, and it is emptied when
    it has `limit` entries, so a worker's memory stays bounded."""

    def __init__(self, function, limit: int, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.function(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, beside others on the same machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(function):
    """A function of one or two Arrow tables that releases memory after each call."""

    def one(table):
        try:
            return function(table)
        finally:
            release()

    def two(left, right):
        try:
            return function(left, right)
        finally:
            release()

    return one if function.__code__.co_argcount == 1 else two


def in_parts(batches, column: int, size: int = 8 << 20):
    """Batches of about `size` bytes of a column, so that a worker holds few long texts as objects at a time."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, size * batch.num_rows // max(1, batch.column(column).nbytes)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
            release()
