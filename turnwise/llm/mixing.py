"""Mixing to target weights with soft membership.

A classifier fitted on labelled rows gives each document's posterior over domains. Nonnegative rates then minimise the
squared distance between the expected tokens of each domain, sum of rate * tokens * posterior, and the targets, by
projected gradient from a rate of one. A step moves a document's rate by its posterior times a vector that is the same
for all (the residual, scaled by the inverse curvature of the documents still free to move, or plain), so an iteration is
two aggregates over (tokens, posterior) and only such vectors, as long as the number of domains, pass the driver.

Training takes at most TRAIN_DOCS labelled documents in order of a hash of their id (of rows that share an id, the shortest
text), so what the driver trains on doesn't grow with the rows of an id. Inputs are the words (hashed to
WORDS buckets, those that tell domains apart by |z| >= Z) and the shares of character classes; labels, ids, lang and
source are not. Null text counts as empty. Without labels the posterior is even. A domain no document can supply keeps
what residual it has. Repeated rows are documents of their own; a null doc_id is kept."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from turnwise.llm.common import Words, durable, runs

TRAIN_DOCS, WORDS, Z, EPOCHS = 4000, 1 << 18, 4.0, 200
ITERATIONS, TOLERANCE, STALL, TRIES = 30, 2e-5, 1e-5, 3
#: Lengths tried of the scaled gradient, and of the plain one.
LENGTHS = (1.0, 0.5, 0.2, 0.05), (1.0, 4.0, 16.0, 64.0)
_CLASSES = np.zeros((256, 5))
_CLASSES[65:91, 0] = 1  # capitals
_CLASSES[list(b"#*$%&|<>"), 1] = 1
_CLASSES[48:58, 2] = 1
_CLASSES[list(b"!?"), 3] = 1
_CLASSES[list(b" \n\t"), 4] = 1


def document_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs as two arrays, dense features, and the number of words of each text."""
    w = Words(texts, lower=True)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(doc * WORDS + (w.hashes() % np.uint64(WORDS)).astype(np.int64))
    sizes = np.asarray([len(x) for x in texts.cast(pa.large_binary()).to_pylist()])
    raw = Words(texts).data
    share = np.zeros((len(n), _CLASSES.shape[1]))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(_CLASSES.shape[1]):
            share[full, k] = np.add.reduceat(_CLASSES[raw, k], starts) / sizes[full]
    distinct = np.bincount(pairs // WORDS, minlength=len(n)) / np.maximum(n, 1)
    dense = np.column_stack([np.ones(len(n)), share * 10, distinct, np.log1p(n) / 5])
    return pairs // WORDS, pairs % WORDS, dense, n


class Classifier:
    """Softmax regression on selected word buckets and dense features."""

    def __init__(self, domains: list[str]):
        self.domains, self.slot = domains, np.full(WORDS, -1, np.int32)
        self.words, self.dense = np.zeros((0, len(domains))), None

    def posterior(self, doc, bucket, dense) -> np.ndarray:
        z = dense @ self.dense if self.dense is not None else np.zeros((len(dense), len(self.domains)))
        slot = self.slot[bucket]
        use = slot >= 0
        for d in range(len(self.domains)):
            z[:, d] += np.bincount(doc[use], self.words[slot[use], d], len(dense))
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, doc, bucket, dense, y) -> "Classifier":
        d, n = len(self.domains), len(y)
        share = np.bincount(y, minlength=d) / n
        if (share > 0).sum() < 2:
            return self
        df = np.bincount(bucket, minlength=WORDS)
        z = np.zeros(WORDS)
        for k in range(d):
            seen = np.bincount(bucket, (y[doc] == k).astype(float), WORDS)
            z = np.maximum(z, np.abs(seen - df * share[k]) / np.sqrt(np.maximum(df * share[k] * (1 - share[k]), 0.3)))
        chosen = np.flatnonzero((z >= Z) & (df >= 4))
        self.slot[chosen] = np.arange(len(chosen))
        self.words, self.dense = np.zeros((len(chosen), d)), np.zeros((dense.shape[1], d))
        slot = self.slot[bucket]
        doc, slot = doc[slot >= 0], slot[slot >= 0]
        moments = [np.zeros_like(x) for x in (self.words, self.dense, self.words, self.dense)]
        target = np.eye(d)[y]
        for step in range(1, EPOCHS + 1):
            s = dense @ self.dense
            for k in range(d):
                s[:, k] += np.bincount(doc, self.words[slot, k], n)
            p = np.exp(s - s.max(1, keepdims=True))
            error = (target - p / p.sum(1, keepdims=True)) / n
            grads = [np.stack([np.bincount(slot, error[doc, k], len(chosen)) for k in range(d)], 1) - 1e-4 * self.words, dense.T @ error - 1e-5 * self.dense]
            for i, (value, g) in enumerate(zip((self.words, self.dense), grads, strict=True)):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[2 + i] = 0.99 * moments[2 + i] + 0.01 * g**2
                value += 0.1 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[2 + i] / (1 - 0.99**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = TRAIN_DOCS) -> Classifier:
    """A classifier from `most` rows at most of labelled (doc_id, domain), a text each."""
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "domain").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t")).select("doc_id", "t.text", "domain")

    def measured(batches):
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                doc, bucket, dense, _ = document_features(some.column(1))
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in dense], pa.binary())], names=["doc_id", "domain", "words", "dense"])

    rows = sorted(texts.mapInArrow(measured, "doc_id bigint, domain string, words binary, dense binary").collect(), key=lambda r: (r.doc_id, r.words))
    model = Classifier(domains)
    if not rows:
        return model
    words = [np.frombuffer(r.words, "<i4") for r in rows]
    return model.train(np.repeat(np.arange(len(rows)), [len(w) for w in words]), np.concatenate(words), np.stack([np.frombuffer(r.dense) for r in rows]), np.array([domains.index(r.domain) for r in rows]))


def _posteriors(model: Classifier):
    def scored(batches):
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                doc, bucket, dense, n = document_features(some.column(1))
                p = model.posterior(doc, bucket, dense)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n.astype(float)), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n", "p"])

    return scored


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n (words) and p, the posterior in the order of model.domains."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_posteriors(model), "doc_id bigint, n double, p array<double>")


def _moved(r: Column, step: np.ndarray, most: float | None) -> Column:
    r = F.greatest(r - sum((F.col("p")[k] * float(v) for k, v in enumerate(step)), F.lit(0.0)), F.lit(0.0))
    return r if most is None else F.least(r, F.lit(most))


def _rate(steps: list[np.ndarray], most: float | None) -> Column:
    r = F.lit(1.0)
    for step in steps:
        r = _moved(r, step, most)
    return r


def solve(members: DataFrame, targets: np.ndarray, most: float | None = None) -> list[np.ndarray]:
    """The steps of the projected gradient; _rate() makes rates of them. members: n and p, durable.

    An iteration is two aggregates: the curvature of the documents that are free to move (not held at a bound by the
    residual), then the residual after each of a few lengths of the scaled and of the plain gradient, with and without momentum, of
    which the nearest is taken; the plain gradient's shortest (one over the largest curvature) can't lead away. It ends at the tolerance, when
    TRIES iterations in a row gain little, or after ITERATIONS; targets out of reach are then approached, not met."""
    d, steps, failures = len(targets), [], 0
    total = max(1.0, float(np.sum(targets)))

    def sums(r: DataFrame, named: dict[str, Column]) -> np.ndarray:
        values = r.agg(*(F.sum(c).alias(name) for name, c in named.items())).first()
        return np.array([values[name] or 0.0 for name in named])

    n, p = F.col("n"), [F.col("p")[k] for k in range(d)]
    rated = lambda: members.select("n", "p", _rate(steps, most).alias("r"))
    residual = sums(rated(), {f"a{k}": n * F.col("r") * p[k] for k in range(d)}) - targets
    most_curved = None
    for _ in range(ITERATIONS):
        far = float(np.linalg.norm(residual))
        if far <= TOLERANCE * total or failures == TRIES:
            break
        slope = sum((p[k] * float(residual[k]) for k in range(d)), F.lit(0.0))
        free = (F.col("r") > 0) | (slope < 0)
        free = free if most is None else free & ((F.col("r") < most) | (slope > 0))
        names = [(i, j) for i in range(d) for j in range(i, d)]
        curves = {f"h{i}_{j}": F.when(free, n * p[i] * p[j]).otherwise(0.0) for i, j in names}
        whole = {f"w{i}_{j}": n * p[i] * p[j] for i, j in names} if most_curved is None else {}
        found = dict(zip([*curves, *whole], sums(rated(), curves | whole), strict=True))
        square = lambda letter: np.array([[found[f"{letter}{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        most_curved = most_curved or max(float(np.linalg.eigvalsh(square("w"))[-1]), 1e-9)
        scaled = np.linalg.solve(square("h") + np.eye(d) * (1e-6 * total + 1e-9), residual)
        tries = [scaled * a for a in LENGTHS[0]] + [residual / most_curved * a for a in LENGTHS[1]]
        if steps:  # momentum: the last step once more, alone or with a new one
            tries += [steps[-1], steps[-1] * 0.5, scaled + steps[-1] * 0.5, residual / most_curved * 4 + steps[-1]]
        moved = {f"{t}_{k}": n * _moved(F.col("r"), step, most) * p[k] for t, step in enumerate(tries) for k in range(d)}
        after = sums(rated(), moved).reshape(len(tries), d) - targets
        best = int(np.linalg.norm(after, axis=1).argmin())
        gained = far - float(np.linalg.norm(after[best]))
        if gained > 0:
            steps, residual = [*steps, tries[best]], after[best]
        failures = 0 if gained > STALL * total else failures + 1
    return steps


def rates(docs: DataFrame, model: Classifier, weights: dict[str, float], budget: float = 1.0, most: float | None = None) -> DataFrame:
    """doc_id, n, p and rate. The targets are weights (normed) times budget times the words of docs."""
    members = durable(posteriors(docs, model), "members")
    words = members.agg(F.sum("n")).first()[0] or 0.0
    w = np.array([weights.get(x, 0.0) for x in model.domains])
    steps = solve(members, w / w.sum() * budget * words, most)
    return members.withColumn("rate", _rate(steps, most))


#: Domains of the labelled table and the production targets.
DOMAINS = ["good", "low", "toxic"]
WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def labelled(labels: DataFrame) -> DataFrame:
    """The labels table as (doc_id, domain)."""
    return labels.where("toxic is not null and quality is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain"))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = rates(docs, fit(docs, labelled(labels), DOMAINS), WEIGHTS)
    return found.select("doc_id", F.col("n").cast("long").alias("n_tokens"), *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate")


def keep(docs: DataFrame, model: Classifier, weights: dict[str, float]) -> DataFrame:
    """The rows of docs that the rates draw, with their own columns: a row stays if its rate, at most 1, exceeds a number in
    [0, 1) hashed from its doc_id and text. The budget is the share of words expected in the weighted domains, so that
    documents of those are kept and the others' rates fall towards zero."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("t"))

    def scored(batches):
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                doc, bucket, dense, n = document_features(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n.astype(float)), pa.array(list(model.posterior(doc, bucket, dense)), pa.list_(pa.float64()))], names=["row", "n", "p"])

    schema = StructType([rows.schema["row"], StructField("n", DoubleType()), StructField("p", ArrayType(DoubleType()))])
    members = durable(rows.mapInArrow(scored, schema), "members")  # classified once; the solver reads n and p alone
    totals = members.agg(*(F.sum(F.col("n") * F.col("p")[k]).alias(d) for k, d in enumerate(model.domains))).first()
    w = np.array([weights.get(x, 0.0) for x in model.domains])
    budget = sum(totals[d] or 0.0 for d in model.domains if weights.get(d))
    steps = solve(members.select("n", "p"), w / w.sum() * budget, 1.0)
    draw = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 20)) / float(1 << 20)
    return members.where(_rate(steps, 1.0) > draw).select("row.*")
