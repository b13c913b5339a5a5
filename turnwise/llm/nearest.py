"""Nearest neighbours by a block matrix join: int8 product tiles, bounds on their error, exact scores of what survives.

Nearness is the cosine in double precision. Queries come to the tasks in slices of about SLICE bytes (one pass over the
candidates a slice; this bounds what is broadcast), candidates as they are scanned. A slice and each BLOCK of candidates are
normalised and rounded to int8 with one scale; a tile's products are sums of integers below 2^24, so float32 matrix products
of the codes are exact. With residuals of lengths e and f, a product lies within e + (1 + e) f of the cosine, so only pairs
whose upper bound reaches the query's worst kept score are computed again, in double precision, term by term in the order of
the components (equal vectors thus tie exactly). Each query keeps its best NEAREST + 1; tasks' results are merged by Spark.
The search is exact: its recall is 1.

Queries with the same vector are searched once, as a class, and so a common vector costs no square; one place more than
asked for is kept, as a query is no candidate of its own. No candidate is shuffled.

Rows with a null vec_id take no part, nor vectors that are null, empty, zero or hold null or non-finite components; vectors
of another length than the query's are no candidates of it. Repeated rows count once; if rows of one vec_id differ, its best
one counts as candidate and each as query. Equal scores go by smaller vec_id. An empty table gives no rows; other columns
are not read."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import durable

NEAREST, EVERY, LEVELS, BLOCK, TILE, SLICE = 5, 50, 127, 4096, 512, 32 << 20
#: Room for the rounding of float32 and of the bound itself.
_SLACK = 1e-6
#: Surviving pairs that are computed at once.
_PAIRS = 1 << 16


def vectors(column: pa.Array):
    """(rows, matrix) for each length of vector in a column of lists: the rows that take part, as doubles scaled by powers of two."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.array(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null becomes NaN
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[begins[rows][:, None] + np.arange(d)]
        use = np.isfinite(x).all(1) & (x != 0).any(1)
        if use.any():
            x = x[use]
            yield rows[use], np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the columns of two matrices, their terms added in order."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


class Coded:
    """Vectors (a row each), their norms, int8 codes of one scale as exact float32 numbers, and the greatest residual."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x.T)
        self.norm = np.sqrt(dots(self.x, self.x))
        unit = x / self.norm[:, None]
        self.scale = float(np.abs(unit).max()) / LEVELS
        codes = np.rint(unit / self.scale).astype(np.int8)
        self.error = float(np.sqrt(((unit - self.scale * codes) ** 2).sum(1)).max())
        self.codes = codes.astype(np.float32)


class Best:
    """The best `most` candidates of each query so far: distinct ids, by score and then id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.score, self.id = np.full((queries, most), -np.inf), np.full((queries, most), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(query)
        held = self.score[own] > -np.inf
        query = np.concatenate([query, np.repeat(own, held.sum(1))])
        ids, score = np.concatenate([ids, self.id[own][held]]), np.concatenate([score, self.score[own][held]])
        order = np.lexsort((-score, ids, query))
        query, ids, score = query[order], ids[order], score[order]
        once = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]
        query, ids, score = query[once], ids[once], score[once]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.most
        self.score[own], self.id[own] = -np.inf, np.iinfo(np.int64).max
        self.score[query[top], place[top]], self.id[query[top], place[top]] = score[top], ids[top]


def _tile(queries: Coded, lo: int, hi: int, block: Coded, ids: np.ndarray, best: Best, distinct: bool) -> None:
    """Adds what a block of candidates has for queries lo to hi."""
    products = queries.codes[lo:hi] @ block.codes.T
    unit = queries.scale * block.scale
    bound = queries.error + (1 + queries.error) * block.error + _SLACK
    least = (best.score[lo:hi, -1] - bound) / unit
    if distinct and products.shape[1] > best.most:  # what is kept in the end is no worse than the tile's own best
        place = products.shape[1] - best.most
        least = np.maximum(least, np.partition(products, place, axis=1)[:, place] - 2 * bound / unit) if (least == -np.inf).any() else least
    at, item = np.nonzero(products >= least[:, None])
    for k in range(0, len(at), _PAIRS):
        q, c = at[k : k + _PAIRS] + lo, item[k : k + _PAIRS]
        best.add(q, ids[c], dots(queries.x[:, q], block.x[:, c]) / (queries.norm[q] * block.norm[c]))


def _searched(parts: list[tuple[np.ndarray, np.ndarray]], most: int):
    """A task's pass over its candidates, for one slice of queries (classes and vectors, by length)."""
    def search(batches):
        ready = {x.shape[1]: (classes, Coded(x), Best(len(x), most)) for classes, x in parts}
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, x in vectors(batch.column(1)):
                if x.shape[1] not in ready:
                    continue
                _, queries, best = ready[x.shape[1]]
                for k in range(0, len(rows), BLOCK):
                    ids, block = names[rows[k : k + BLOCK]].astype(np.int64), Coded(x[k : k + BLOCK])
                    distinct = len(np.unique(ids)) == len(ids)
                    for lo in range(0, len(best.score), TILE):
                        _tile(queries, lo, min(lo + TILE, len(best.score)), block, ids, best, distinct)
        for classes, _, best in ready.values():
            q, k = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(classes[q]), pa.array(best.id[q, k]), pa.array(best.score[q, k])], names=["class", "vec_id", "score"])

    return search


def _taking_part(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))


def neighbours(candidates: DataFrame, queries: DataFrame, most: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `most` nearest candidates of each query, or all there are. Both: vec_id, embedding.

    A vec_id that is in both is the same thing: a query doesn't find itself."""
    spark = candidates.sparkSession
    asked = _taking_part(queries).distinct()
    classes = durable(asked.select("embedding").distinct().withColumn("class", F.monotonically_increasing_id()), "query-classes")  # written, so numbers stay
    members = asked.join(classes, "embedding").select(F.col("vec_id").alias("query_id"), "class")
    pool = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    n = -(-(classes.agg(F.sum(8 * F.size("embedding").cast("long"))).first()[0] or 0) // SLICE)
    found = spark.createDataFrame([], "class long, vec_id long, score double")
    for k in range(n):
        table = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(n)) == k).select("class", "embedding").toArrow()
        ids = table.column(0).to_numpy()
        parts = [(ids[rows], x) for rows, x in vectors(table.column(1).combine_chunks())]
        found = found.union(pool.mapInArrow(_searched(parts, most + 1), "class long, vec_id long, score double"))
    tops = found.groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    tops = tops.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("_r") <= most + 1).drop("_r")
    pairs = members.join(tops, "class").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op11(embeddings: DataFrame) -> DataFrame:
    return neighbours(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))


_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, t: s + t)"
SQL = f"""with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt({_DOT.format(a="e", b="e")}) as norm from v),
p as (select q.vec_id as query_id, c.vec_id, {_DOT.format(a="q.e", b="c.e")} / (q.norm * c.norm) as score
 from n q join n c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % {EVERY} = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p qualify rank <= {NEAREST}"""
