"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's features are hashes of its words and of its runs of three bytes, each at the
share it has in the line, and STATS of its length and its repeats; no character or word is singled out, all weights are
learned. A line is scored by its own features, those of the line before and those of the line after; the chain adds a
transition weight for each pair of neighbouring labels. Training lines take their document's label. The forward-backward
marginals of "good" are averaged by line length, and a logistic calibration on the training documents turns that mean
into the score.

Training uses at most TRAIN_DOCS labelled documents of TRAIN_BYTES together, taken in order of a hash of their id (up to the first
that doesn't fit; one larger than that alone is passed over), from rows whose crc32(doc_id as text) mod 3 is not 1; only they
reach the driver. Labels, lang, source and doc_id are no inputs of a score. Null or empty text is one empty line; an empty table
gives no rows; texts are scored whole, of any length; extra columns are not read. Without labels of both kinds every score
is 0.5. Repeated rows are scored alike; a null doc_id is not held out (its remainder counts as 0)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import Words, mix, runs, whole_text

TRAIN_DOCS, TRAIN_BYTES, ROUNDS = 3000, 2 << 20, 150
#: Slots of hashed words and of hashed runs of three bytes, the weight of a whole line's share, and statistics of a line:
#: one, no words, at most 2, at least 12, under half of more than 3 words distinct, under 0.6 of more than 7 pairs distinct, seen before.
SLOTS, SHARE, STATS = 4096, 8.0, 7
OWN = 2 * SLOTS + STATS


def _repeats(lines: list[bytes]):
    """For each line, whether it stands before in its text."""
    seen: set[bytes] = set()
    for line in lines:
        yield line in seen
        seen.add(line)


def _once(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The line of each distinct (line, hash)."""
    return line[np.unique(mix(hashes + mix(line.astype(np.uint64))), return_index=True)[1]]


class Lines:
    """The lines of some texts: where they are, whose they are, and their features as slots of words and bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        words, at = Words(texts), offsets - offsets[0]
        data, ends_of_lines = words.data, np.flatnonzero(words.data == 10)
        start = np.concatenate([at[:-1], ends_of_lines + 1])
        text = np.concatenate([np.arange(len(texts)), np.searchsorted(at, ends_of_lines, "right") - 1])
        order = np.lexsort((np.arange(len(start)), start, text))
        self.start, self.text = start[order], text[order]
        last = np.append(self.text[1:] != self.text[:-1], True)[: len(self.text)]
        self.end = np.where(last, at[self.text + 1], np.append(self.start[1:], 0)[: len(self.start)] - 1)
        self.sizes = (self.end - self.start + 1).astype(float)
        self.counts = np.bincount(self.text, minlength=len(texts))
        hashes = words.hashes()
        self.word = (hashes % np.uint64(SLOTS)).astype(np.int64)
        self.words = np.searchsorted(words.starts, self.start), np.searchsorted(words.starts, self.end)
        wide = data.astype(np.uint32)
        three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(data) > 2 else np.empty(0, np.uint32)
        self.byte = ((three * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        self.bytes = np.minimum(self.start, len(self.byte)), np.clip(self.end - 2, np.minimum(self.start, len(self.byte)), len(self.byte))
        self.seen = np.array([x for t in texts.to_pylist() for x in _repeats(t.split(b"\n"))], bool)
        self.stats = self._stats(hashes)

    def _stats(self, hashes: np.ndarray) -> np.ndarray:
        lo, hi = self.words
        n = hi - lo
        line = np.repeat(np.arange(len(n)), n)
        within = np.flatnonzero(line[1:] == line[:-1]) if len(line) else np.empty(0, np.int64)
        hashes = hashes[: len(line)]
        pairs = hashes[within] * np.uint64(0x9E3779B97F4A7C15) + hashes[within + 1]
        distinct, both = (np.bincount(_once(own, of), minlength=len(n)) for own, of in ((hashes, line), (pairs, line[within])))
        return np.stack([np.ones(len(n)), n == 0, n <= 2, n >= 12, (n > 3) & (distinct < 0.5 * n), (n > 8) & (both < 0.6 * (n - 1)), self.seen], 1).astype(float)
def marginals(scores: list[np.ndarray], turn: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """P(good) of every line of each chain, and the expected count of each label pair. scores: a line's log-odds of good.

    Chains run side by side, longest first, so a step handles all chains that still have a line there."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]  # chains with more than t lines
    flat, at = np.concatenate([scores[i] for i in order]) if longest else np.empty(0), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    unary = np.exp(np.stack([np.zeros_like(flat), np.clip(flat, -30, 30)], 1))
    unary /= unary.sum(1, keepdims=True)
    move = np.exp(turn - turn.max())
    forward, backward, pairs = np.empty_like(unary), np.ones_like(unary), np.zeros((2, 2))
    for t in range(longest):
        rows = at[: live[t]] + t
        a = unary[rows] * (forward[rows - 1] @ move if t else 1)
        forward[rows] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        rows = at[: live[t + 1]] + t
        ahead = unary[rows + 1] * backward[rows + 1]
        joint = forward[rows][:, :, None] * move * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = ahead @ move.T
        backward[rows] = b / b.sum(1, keepdims=True)
    good = forward * backward
    good = good[:, 1] / good.sum(1)
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    for k, i in enumerate(order):
        out[i] = good[at[k] : at[k] + sizes[k]]
    return out, pairs


def _within(values: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of values between each pair of bounds."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1]] - total[bounds[0]]


def _shares(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The weight of one word and of one run of bytes in each line."""
    return tuple(SHARE / np.maximum(1, hi - lo) for lo, hi in (lines.words, lines.bytes))


def line_scores(lines: Lines, w: np.ndarray) -> np.ndarray:
    """A line's log-odds of good by weights (3, OWN) of its own features, of the line before and of the line after."""
    of_word, of_bytes = _shares(lines)
    own, before, after = (of_word * _within(v[:SLOTS][lines.word], lines.words) + of_bytes * _within(v[SLOTS : 2 * SLOTS][lines.byte], lines.bytes) + lines.stats @ v[2 * SLOTS :] for v in w)
    same = lines.text[1:] == lines.text[:-1]
    own[1:] += np.where(same, before[:-1], 0)
    own[:-1] += np.where(same, after[1:], 0)
    return own


def _slope(lines: Lines, rest: np.ndarray) -> np.ndarray:
    """The gradient of sum(rest * line_scores) by the weights."""
    same = (lines.text[1:] == lines.text[:-1]).astype(float)
    of_word, of_bytes = _shares(lines)
    out = []
    for g in (rest, np.append(rest[1:] * same, 0), np.insert(rest[:-1] * same, 0, 0)):
        parts = []
        for slots, bounds, share in ((lines.word, lines.words, of_word), (lines.byte, lines.bytes, of_bytes)):
            edge = np.zeros(len(slots) + 1)
            np.add.at(edge, bounds[0], g * share)
            np.subtract.at(edge, bounds[1], g * share)
            parts.append(np.bincount(slots, np.cumsum(edge)[:-1], SLOTS))
        out.append(np.concatenate([*parts, lines.stats.T @ g]))
    return np.stack(out)


def train(texts: pa.Array, labels: np.ndarray) -> dict:
    """Weights by gradient ascent (Adam) on the chains' log-likelihood, then the calibration."""
    if len(set(labels.tolist())) < 2:
        return {"w": np.zeros((3, OWN)), "turn": np.zeros((2, 2)), "a": 0.0, "b": 0.0}
    lines = Lines(texts)
    counts, cut = lines.counts, np.cumsum(lines.counts)[:-1]
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / counts * len(labels)
    y, weight = np.repeat(labels, counts).astype(float), np.repeat(share, counts)
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (labels, labels), counts - 1)
    theta = np.zeros(3 * OWN + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        good, pairs = marginals(np.split(line_scores(lines, theta[: 3 * OWN].reshape(3, OWN)), cut), theta[3 * OWN :].reshape(2, 2))
        grad = np.concatenate([_slope(lines, weight * (y - np.concatenate(good))).ravel() / len(labels), (true_pairs - pairs).ravel() / counts.sum()]) - 1e-4 * theta
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        theta[3 * OWN :] = np.clip(theta[3 * OWN :], -1.5, 1.5)
    model = {"w": theta[: 3 * OWN].reshape(3, OWN), "turn": theta[3 * OWN :].reshape(2, 2), "a": 1.0, "b": 0.0}
    mean = _means(lines, model)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(model["a"] * mean + model["b"], -30, 30)))
        model["a"] += 2.0 * (((labels - p) * mean).mean() / max(1e-6, (mean**2).mean()))
        model["b"] += 1.0 * (labels - p).mean()
    return model


def _means(lines: Lines, model: dict) -> np.ndarray:
    """Log-odds of the length-weighted mean of the lines' marginals, a text each."""
    good, _ = marginals(np.split(line_scores(lines, model["w"]), np.cumsum(lines.counts)[:-1]), model["turn"])
    mean = np.bincount(lines.text, np.concatenate(good) * lines.sizes, len(lines.counts)) / np.bincount(lines.text, lines.sizes, len(lines.counts))
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def probability(texts: pa.Array, model: dict) -> np.ndarray:
    """The score of each text."""
    return 1 / (1 + np.exp(-np.clip(model["a"] * _means(Lines(texts), model) + model["b"], -30, 30)))


def held_out(doc_id):
    """The rows that training never sees: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, room: int = TRAIN_BYTES) -> dict:
    """A model from at most `most` labelled documents, of `room` bytes together, that are not held out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.orderBy(*order).limit(most)
    texts = whole_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.octet_length("text").alias("size"))  # at most `most` rows
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct("size", "text")).alias("t")).select("doc_id", "quality", "t.*")  # of rows that share an id, the shortest
    upto = F.sum(F.when(F.col("size") <= room, F.col("size")).otherwise(0)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("upto", upto).where((F.col("size") <= room) & (F.col("upto") <= room)).orderBy(*order).select("quality", "text").collect()
    return train(pa.array([r.text for r in rows], pa.string()), np.array([r.quality for r in rows], int))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score; one pass over the texts, no shuffle."""

    def scored(batches):
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(probability(some.column(1), model))], names=["doc_id", "score"])

    return whole_text(docs).mapInArrow(scored, "doc_id bigint, score double")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
