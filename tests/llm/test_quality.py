"""op8: features and scores of whole documents against plain Python, learning without the marks that junk lines carry, hostile rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnwise.llm import crf_quality as Q
from turnwise.llm.common import Words

TEXTS = ["", "one", "a b a b a b a b a b a b\nx", "\n\nshort line\n", "é ß 𝕏 words\nthat go on | and on !!! ###\nshort line\nshort line", "tail\n", "\n"]


def line_by_hand(line, seen, w):
    """A line's score under one weight vector."""
    words = line.split()
    slot = lambda x: int(Words(pa.array([x], pa.large_binary())).hashes()[0] % np.uint64(Q.SLOTS))
    byte = [((line[i] | line[i + 1] << 8 | line[i + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 20 for i in range(len(line) - 2)]
    pairs = set(itertools.pairwise(words))
    n = len(words)
    stats = [1, n == 0, n <= 2, n >= 12, n > 3 and len(set(words)) < 0.5 * n, n > 8 and len(pairs) < 0.6 * (n - 1), seen]
    total = Q.SHARE / max(1, n) * sum(w[slot(x)] for x in words) + Q.SHARE / max(1, len(byte)) * sum(w[Q.SLOTS + b] for b in byte)
    return total + sum(float(s) * x for s, x in zip(stats, w[2 * Q.SLOTS :], strict=True))


def score_by_hand(text, model):
    """The calibrated, length-weighted mean of marginals, over all labellings of the lines."""
    lines = (text or "").encode().split(b"\n")
    seen = [x in lines[:k] for k, x in enumerate(lines)]
    own, before, after = ([line_by_hand(x, s, w) for x, s in zip(lines, seen, strict=True)] for w in model["w"])
    odds = [own[k] + (before[k - 1] if k else 0) + (after[k + 1] if k + 1 < len(lines) else 0) for k in range(len(lines))]
    good, whole = np.zeros(len(lines)), 0.0
    for labels in itertools.product((0, 1), repeat=len(lines)):
        weight = np.exp(sum(o * y for o, y in zip(odds, labels, strict=True)) + sum(model["turn"][a, b] for a, b in itertools.pairwise(labels)))
        whole += weight
        good += weight * np.array(labels)
    sizes = np.array([len(x) + 1 for x in lines])
    mean = np.clip((good / whole * sizes).sum() / sizes.sum(), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model["a"] * np.log(mean / (1 - mean)) + model["b"])))


def test_scores_of_whole_documents():
    rng = np.random.default_rng(1)
    model = {"w": rng.normal(0, 0.3, (3, Q.OWN)), "turn": rng.normal(0, 0.7, (2, 2)), "a": 0.8, "b": -0.2}
    r = random.Random(2)
    texts = TEXTS + ["\n".join(" ".join(r.choice(["ab", "c", "Ünd", "x|", "9"]) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 7))) for _ in range(40)]
    got = Q.probability(pa.array(texts), model)
    assert np.allclose(got, [score_by_hand(t, model) for t in texts], atol=1e-9)
    assert np.allclose(got, [Q.probability(pa.array([t]), model)[0] for t in texts], atol=1e-9)
    assert np.allclose(Q.probability(pa.array(["x", *texts]).slice(1), model), got, atol=1e-9)


def test_slope_is_that_of_the_scores():
    rng = np.random.default_rng(3)
    lines = Q.Lines(pa.array(TEXTS))
    rest, w = rng.normal(size=len(lines.text)), rng.normal(size=(3, Q.OWN))
    slope = Q._slope(lines, rest)
    for _ in range(20):
        step = rng.normal(size=w.shape)
        assert np.isclose((slope * step).sum(), (rest * (Q.line_scores(lines, w + step) - Q.line_scores(lines, w))).sum())


def test_learns_without_the_marks(spark):
    """With every mark that rules look for taken out of all texts, held-out documents are still told apart."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    bare = docs.withColumn("text", F.regexp_replace("text", r"[#*$%&|<>!]", ""))
    for table, least in ((docs, 0.97), (bare, 0.95)):
        rows = Q.op8(table, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").toPandas()
        assert len(rows) > 100 and (rows.predicted == rows.quality).mean() >= least


def test_hostile_rows(spark):
    schema = "doc_id long, text string, score double, quality int"
    good, bad = "A plain line of words that says something.\n" * 3, "## ## $$ || !!\n" * 3
    rows = [(k, good if k % 2 else bad, 0.0, 5) for k in range(40)] + [(None, good, 0.0, 5), (3, good, 0.0, 5), (3, None, 0.0, 5), (99, "", 0.0, 5), (100, "long " * 200_000, 0.0, 5)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.op8(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id != 3)
    assert Q.op8(docs.limit(0), labels).collect() == [] and {r.score for r in Q.op8(docs, labels.limit(0)).collect()} == {0.5}
    small = Q.fit(docs, labels, room=300)  # what is too long for the room is no example
    assert np.isfinite(small["w"]).all() and not re.search("long", repr(small))
