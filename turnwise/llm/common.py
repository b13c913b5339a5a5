"""Shared helpers: durable intermediate tables, word arrays over Arrow buffers, connected components."""

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Other characters that part words where punctuation is no part of them: all ASCII but letters and digits.
PUNCTUATION = np.array([not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 128) for x in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master, as in tests, may do without: a
    temporary folder then serves."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="turnwise-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, a query's shuffle files are removed when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def durable(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df written to the shared folder and read again, so that lost executors cost no recomputation of its lineage."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", options)


def _written(df: DataFrame, at: str, options: dict | None = None) -> DataFrame:
    df.write.options(**(options or {})).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """Durable tables that no result reads: remove() deletes them when the computation is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.at}/{self.n}")

    def remove(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, the key and the text with null as the empty string; other columns are pruned from the scan."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else pow(_BASE, -1, 2**64))
        _powers[kind] = have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), base, np.uint64)]))
    return have[:n]


class Words:
    """Words of consecutive texts as spans of one byte array; text i has words first[i]:first[i+1]."""

    def __init__(self, texts: pa.Array, lower: bool = False, parted_by: np.ndarray = _IS_SPACE):
        texts = texts.cast(pa.large_binary()) if not isinstance(texts, pa.LargeBinaryArray) else texts
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
        self.data = _LOWER[self.data] if lower else self.data
        at = at - at[0]
        word = ~parted_by[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[at] = True
        self.starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
        self.ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1 if len(word) else np.empty(0, np.int64)
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, alike wherever the word stands."""
        n = len(self.data)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("up", n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _power("down", n)[self.starts] + (self.ends - self.starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `width` words at every word, and whether the shingle lies within one text."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        out[: n - k] += words[k:] * np.uint64(pow(_BASE, 2 * k + 3, 2**64))
    inside = np.ones(n, bool)
    for k in range(1, width):
        inside[np.maximum(first[1:] - k, first[:-1])[first[1:] > first[:-1]]] = False
    if n:
        inside[max(0, n - width + 1) :] = False
        if width == 1:
            inside[:] = True
    return mix(out), inside


def runs(texts: pa.Array, most: int = 1 << 20):
    """(from, to) of consecutive texts holding about `most` bytes; a longer text stands alone."""
    sizes = np.cumsum(np.asarray(texts.cast(pa.large_binary()).value_lengths(), dtype=np.int64)) if hasattr(texts, "value_lengths") else np.cumsum([len(x) for x in texts.cast(pa.large_binary()).to_pylist()])
    lo, done = 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield lo, hi
        lo, done = hi, sizes[hi - 1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of edges (a, b); component is the smallest id reachable.

    Each round hooks every node to the neighbour that comes first in hash order, follows those hooks twice and keeps
    the edges between what is left, so the graph shrinks by a constant factor whatever its shape. Nothing is collected.
    Every table of a round is written to the shared folder (removed at the end), aggregates included: a hub's or a giant
    component's rows then meet its one row in a join of two plain shuffles, which adaptive execution splits where skewed."""
    rank = F.xxhash64
    scratch = Scratch(edges.sparkSession, "components")
    rest = scratch.write(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    ids = rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct()
    maps = []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("id"))).alias("m"))
        hook = scratch.write(first.select("a", F.least(F.col("m"), F.struct(rank("a").alias("r"), F.col("a").alias("id")))["id"].alias("p")))
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        hook = scratch.write(hook)
        maps.append(hook)
        left = hook.select("a", F.col("p").alias("x"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("y"))
        rest = scratch.write(rest.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    root = ids.select("id", F.col("id").alias("root"))
    for hook in maps:
        root = root.join(hook.select(F.col("a").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    root = scratch.write(root)
    least = scratch.write(root.groupBy("root").agg(F.min("id").alias("component")))
    out = durable(root.join(least, "root").select("id", "component"), "components")
    scratch.remove()
    return out
