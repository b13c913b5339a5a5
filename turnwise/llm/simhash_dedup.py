"""SimHash near-duplicates through an index of positional bytes.

A 64-bit fingerprint is eight positional bytes. Fingerprints with at most 3 differing bits share at least 5 of them
(MIN_SHARED), and any 5 of 8 positions hold three positions of the first half or three of the second. So the postings
are the eight byte triples within a half: every link meets in a posting list, and a list holds 1 / 2^24 of unrelated
fingerprints where lists of single bytes would hold 1 / 2^8. Inside a list the shared positional bytes of each pair are
tallied, pairs below the guaranteed minimum fall, and the rest are verified by the bits that differ.

Equal fingerprints are one node, so copies cost nothing and a link through rows without a doc_id counts. A list longer than BLOCK is dealt into blocks and pairs of
blocks, each its own row, and each pair of blocks answers with a spanning forest of its links instead of all pairs:
no list lands in one task and connectivity loses no link.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Repeated rows give
repeated results; rows with a null doc_id link like any other, and only a group without any doc_id has a null component.
An empty table gives no rows; other columns are not read."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from turnwise.llm.common import components, durable, whole_text

SEED, RADIUS, BLOCK = 42, 3, 512
MIN_SHARED = 8 - RADIUS
TRIPLES = tuple(x for half in (range(4), range(4, 8)) for x in itertools.combinations(half, 3))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half the XXH64 of the text's 3-word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not words:
        return 0
    joined, width, n = b" ".join(words), min(3, len(words)), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    return whole_text(docs).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def forest(fps: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps; with two sides, of the links between them."""
    shared_rows, parent, out = fps.view(np.uint8).reshape(-1, 8), list(range(len(fps))), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    across = side.min() != side.max()
    for i in range(len(fps) - 1):
        tally = (shared_rows[i + 1 :] == shared_rows[i]).sum(1)
        near = np.flatnonzero(tally >= MIN_SHARED) + i + 1
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= RADIUS]
        for j in (near[side[near] != side[i]] if across else near).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


@pandas_udf(ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())])))
def _links(fps: pd.Series, sides: pd.Series) -> pd.Series:
    found = []
    for f, s in zip(fps, sides, strict=True):
        f, s = np.asarray(f, np.int64).view(np.uint64), np.asarray(s)
        v = f.view(np.int64)
        found.append([{"a": int(v[i]), "b": int(v[j])} for i, j in forest(f, s)])
    return pd.Series(found)


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever fingerprints of nodes (fp, distinct) lie within RADIUS bits."""
    def byte(i):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    keys = F.array(*(F.lit(k << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(TRIPLES)))
    postings = nodes.select("fp", F.explode(keys).alias("key"))
    lists = durable(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "lists")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = postings.join(lists, "key").withColumn("own", own)
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select("key", "fp", "own", other.alias("other")).groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("sides"))
    return met.where(F.size("fps") > 1).select(F.explode(_links("fps", "sides")).alias("l")).select("l.a", "l.b").distinct()


def groups(prints: DataFrame, best: Column) -> DataFrame:
    """fp, grp (the smallest fingerprint that links reach), least (the group's smallest doc_id, null if it has none) and best
    (the group's least value of `best`), a row a fingerprint. prints: durable, with fp and doc_id.

    Rows of a fingerprint, however many, only meet aggregates; what is left is joined a row a fingerprint or a group."""
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.min(best).alias("first")), "nodes")
    found = components(links(nodes.select("fp"))).toDF("fp", "grp")
    placed = durable(nodes.join(found, "fp", "left").withColumn("grp", F.coalesce("grp", "fp")), "placed")
    whole = durable(placed.groupBy("grp").agg(F.min("node").alias("least"), F.min("first").alias("best")), "groups")
    return placed.select("fp", "grp").join(whole, "grp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    prints = durable(fingerprints(docs), "fingerprints")
    of = durable(groups(prints, F.col("doc_id")).select("fp", F.col("least").alias("component_id")), "of")
    return prints.join(of, "fp")  # two plain shuffles, so adaptive execution splits the rows of a common fingerprint


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (null only where the group has no other), of its rows the one
    whose columns hash least; of fully repeated rows one (maps have no hash, so rows that differ in a map alone count as repeated). Rows with a null doc_id are documents like any other."""
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(*hashed).alias("h"))
    texts = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "h", F.coalesce("row.text", F.lit("")).alias("text"))

    def printed(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    prints = durable(texts.mapInArrow(printed, "doc_id bigint, h bigint, fp bigint"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    stays = durable(groups(prints, order).groupBy("grp").agg(F.first("best").alias("best")).select(F.col("best.doc_id").alias("id"), F.col("best.h").alias("h")), "stays")
    return rows.join(stays, "h").where(F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))).dropDuplicates(["h", "id"]).select("row.*")
