"""Language-model scores by deleted interpolation.

P(w | u) = l2 c(u,w) / c(u) + l1 c(w) / N + l0 / (V + 1); the weights depend on the bucket floor(log2(c(u) + 1)) of the
context's count. They are learned by expectation-maximisation on a deleted fold of the training documents (remainder
FOLD), whose own counts are taken off the counts that predict it.

Counts cover all training documents. A scan task cuts its documents into units of about UNIT bytes, which are written to
the shared folder, a row a unit, so that its number stands for the same documents whatever becomes of the executors. A
unit sends its distinct n-grams (steps of ascending hashes) with their counts to hash buckets, a bucket sums them and
answers every unit, so each shuffle carries distinct n-grams of a unit rather than tokens, and a common n-gram costs one
entry a unit. Answers meet the unit's documents by unit. Only N, V and a bounded histogram for the weights reach the
driver. Words and pairs are
known by 64 bits of a hash, at every size.

Null text counts as empty: one end token. A null doc_id counts as held out (crc32 of no text is 0). Repeated rows count
and score as documents of their own; an empty table gives no rows; other columns are not read."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Words, durable, mix, runs, whole_text

FOLDS, HELD_OUT, FOLD = 10, 0, 1
UNIT, BUCKET = 1 << 20, 2 << 20
ALPHA = 0.1
#: How hard units are compressed: they are written once and read twice.
ZSTD = 6
_END = np.uint64(0x5EED0FE27D)
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)
#: The weights' histogram: steps of a quarter octave, at most LEVELS of them each way, for at most 41 buckets.
STEPS, LEVELS, BUCKETS, ROUNDS = 4, 160, 41, 60


def remainder(doc_ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None or d != d else str(int(d)).encode()) % FOLDS for d in doc_ids], np.int64)


class Unit:
    """Tokens of some texts: `words` (distinct hashes, ascending), `pairs` (likewise), each token's place in either, its context's, and its text."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        h = np.insert(w.hashes(), w.first[1:], _END)
        self.lengths = np.diff(w.first) + 1
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.words, self.word = np.unique(np.append(h, _END), return_inverse=True)
        end, self.word = self.word[-1], self.word[:-1]
        self.context = np.concatenate([[end], self.word[:-1]])
        codes, pair = np.unique(self.context * len(self.words) + self.word, return_inverse=True)
        hashes = mix(self.words[codes // len(self.words)] * _CONTEXT + self.words[codes % len(self.words)])
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = hashes[order], place[pair]

    def check(self) -> int:
        return int((np.bitwise_xor.reduce(self.words) ^ np.bitwise_xor.reduce(self.pairs)).view(np.int64))


def _stored(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD))) as to:
        to.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _restored(raw: bytes | pa.Buffer) -> pa.RecordBatch:
    pa.default_memory_pool().release_unused()  # a worker meets many units; none should leave its memory behind
    return pa.ipc.open_stream(raw).read_next_batch()


def _cut(batches):
    """(unit, fold, rows): the documents of a scan task in units. Documents of the fold have odd units of their own."""
    from pyspark import TaskContext

    unit = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi in runs(batch.column(1), UNIT):
            rows = batch.slice(lo, hi - lo)
            fold = remainder(rows.column(0).to_pylist()) == FOLD
            for odd, use in ((0, ~fold), (1, fold)):
                if use.any():
                    some = rows.filter(pa.array(use))
                    yield pa.RecordBatch.from_arrays([pa.array([unit + odd], pa.int64()), pa.array([bool(odd)]), pa.array([_stored(some)], pa.binary())], names=["unit", "fold", "rows"])
            unit += 2


def _planes(numbers: np.ndarray, width: int = 8) -> bytes:
    """All first bytes, then all second bytes, and so on, so that high bytes are runs of zeros, which the shuffle's compression removes."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _joined(raw: bytes, n: int) -> np.ndarray:
    """The n numbers of _planes."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from zero; they need two bytes less than the hashes."""
    return np.diff(ascending, prepend=np.uint64(0))


def _units(batches):
    for batch in batches:
        for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield number, _restored(raw.as_buffer())


def _questions(buckets: int):
    def ask(batches):
        for number, rows in _units(batches):
            unit, fold = Unit(rows.column(1)), remainder(rows.column(0).to_pylist())
            out = {k: [] for k in ("bucket", "unit", "check", "n", "hashes", "train", "fold")}
            sides = []
            for hashes, place in ((unit.words, unit.word), (unit.pairs, unit.pair)):
                counts = [np.bincount(place, (use[unit.text]).astype(float), len(hashes)).astype("<u4") for use in (fold != HELD_OUT, fold == FOLD)]
                at = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                sides.append((hashes, counts, np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))))
            check = unit.check()
            for b in range(buckets):
                cut = [slice(s[2][b], s[2][b + 1]) for s in sides]
                if cut[0].stop - cut[0].start + cut[1].stop - cut[1].start:
                    out["bucket"].append(b)
                    out["unit"].append(number)
                    out["check"].append(check)
                    out["n"].append(cut[0].stop - cut[0].start)
                    out["hashes"].append(_planes(_steps(sides[0][0][cut[0]])) + _planes(_steps(sides[1][0][cut[1]])))
                    for k, name in enumerate(("train", "fold")):
                        out[name].append(_planes(np.concatenate([s[1][k][c] for s, c in zip(sides, cut, strict=True)]), 4))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return ask


_ANSWER = "bucket int, unit bigint, check bigint, n int, train binary, fold binary, v bigint, total bigint, fold_total bigint"


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of a bucket, dealt back to each unit in its own order; a last row has the bucket's statistics."""
    n = group["n"].to_numpy()
    hashes = [np.concatenate([np.cumsum(_joined(x[: 8 * m], m), dtype=np.uint64), np.cumsum(_joined(x[8 * m :], len(x) // 8 - m), dtype=np.uint64)]) for x, m in zip(group["hashes"], n, strict=True)]
    counts = {k: [_joined(x, len(x) // 4) for x in group[k]] for k in ("train", "fold")}
    out, stats = {k: [[None, None] for _ in n] for k in counts}, None
    for side in range(2):
        cut = [slice(0, m) if side == 0 else slice(m, None) for m in n]
        keys, place = np.unique(np.concatenate([h[c] for h, c in zip(hashes, cut, strict=True)]), return_inverse=True)
        sums = {}
        for k, all_counts in counts.items():
            sums[k] = np.bincount(place, np.concatenate([x[c] for x, c in zip(all_counts, cut, strict=True)]).astype(float), len(keys)).astype("<u8")
            at = 0
            for i, h in enumerate(hashes):
                m = len(h[cut[i]])
                out[k][i][side] = sums[k][place[at : at + m]]
                at += m
        if side == 0:
            stats = int((sums["train"] > 0).sum()), int(sums["train"].sum()), int(sums["fold"].sum())
    rows = pd.DataFrame({"bucket": group["bucket"], "unit": group["unit"], "check": group["check"], "n": group["n"], **{k: [_planes(np.concatenate(x)) for x in out[k]] for k in out}, "v": None, "total": None, "fold_total": None})
    last = pd.DataFrame([{"bucket": int(group["bucket"].iloc[0]), "unit": None, "check": None, "n": None, "train": None, "fold": None, "v": stats[0], "total": stats[1], "fold_total": stats[2]}])
    return pd.concat([rows.astype(object), last.astype(object)], ignore_index=True)


def _met(rows: pa.RecordBatch, answers: pd.DataFrame):
    """A unit's tokens with its answers: the unit, then (train, fold) counts of words and of pairs."""
    unit = Unit(rows.column(1))
    answers = answers.sort_values("bucket")
    if set(answers["check"]) != {unit.check()}:
        raise RuntimeError("a unit's answers belong to other documents")
    found = []
    for side, name in ((0, "train"), (0, "fold"), (1, "train"), (1, "fold")):
        if name not in answers:
            found.append(None)
            continue
        parts = [_joined(x, len(x) // 8)[slice(0, m) if side == 0 else slice(m, None)] for x, m in zip(answers[name], answers["n"], strict=True)]
        found.append(np.concatenate(parts).astype(np.float64))
    return unit, *found


def _ratios(unit: Unit, words: np.ndarray, pairs: np.ndarray, total: float, v: int):
    """Bucket of each token's context, and the bigram and unigram estimates over the uniform one."""
    context = words[unit.context]
    two = np.divide(pairs[unit.pair], context, out=np.zeros(len(context)), where=context > 0) * (v + 1)
    one = words[unit.word] / max(total, 1) * (v + 1)
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1), two, one


def weights(histogram: pd.DataFrame) -> np.ndarray:
    """(bucket, 3): l2, l1, l0 by expectation-maximisation; a bucket without data takes its lower neighbour's."""
    out = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    for b in range(BUCKETS):
        h = histogram[histogram["b"] == b]
        if b and not len(h):
            out[b] = out[b - 1]
        if len(h):
            n, x = h["n"].to_numpy(float), np.stack([h["x2"] / h["n"], h["x1"] / h["n"], np.ones(len(h))], 1).astype(float)
            l = np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                part = x * l
                l = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) / n.sum()
            out[b] = l
    out = np.maximum(out, 1e-9)
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    texts = whole_text(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET))
    # Small row groups: a reader's batch of rows is cut at their ends, and a row here is a whole unit.
    units = durable(texts.mapInArrow(_cut, "unit bigint, fold boolean, rows binary"), "units", {"parquet.block.size": str(8 * UNIT)})
    asked = units.select("unit", "rows").mapInArrow(_questions(buckets), "bucket int, unit bigint, check bigint, n int, hashes binary, train binary, fold binary")
    answers = durable(asked.groupBy("bucket").applyInPandas(_answers, _ANSWER), "counts")
    v, total, fold_total = (x or 0 for x in answers.agg(F.sum("v"), F.sum("total"), F.sum("fold_total")).first())
    replies = answers.where("unit is not null").select("bucket", "unit", "check", "n", "train", "fold")

    def spread(docs, answers):
        if not len(docs):
            return pd.DataFrame({k: [] for k in ("b", "k2", "k1", "n", "x2", "x1")})
        unit, wt, wf, pt, pf = _met(_restored(docs["rows"].iloc[0]), answers)
        b, two, one = _ratios(unit, wt - wf, pt - pf, total - fold_total, v)
        level = [np.where(x > 0, np.clip(np.log2(np.maximum(x, 1e-30)) * STEPS + LEVELS / 4, 0, LEVELS), -1).astype(int) for x in (two, one)]
        return pd.DataFrame({"b": b, "k2": level[0], "k1": level[1], "n": 1, "x2": two, "x1": one}).groupby(["b", "k2", "k1"], as_index=False).sum()

    grouped = units.where("fold").select("unit", "rows").groupBy("unit").cogroup(replies.where("unit % 2 = 1").groupBy("unit")).applyInPandas(spread, "b int, k2 int, k1 int, n bigint, x2 double, x1 double")
    mixture = weights(grouped.groupBy("b", "k2", "k1").agg(F.sum("n").alias("n"), F.sum("x2").alias("x2"), F.sum("x1").alias("x1")).toPandas())

    def scored(docs, answers):
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        if not len(docs):
            return pd.DataFrame({k: [] for k in names})
        rows = _restored(docs["rows"].iloc[0])
        unit, wt, _, pt, _ = _met(rows, answers)
        b, two, one = _ratios(unit, wt, pt, total, v)
        p = (mixture[b] * np.stack([two, one, np.ones(len(two))], 1)).sum(1) / (v + 1)
        c, n, ids = wt[unit.word], len(rows), rows.column(0).to_pylist()
        sums = [np.bincount(unit.text, x, n) for x in (c > 0, np.log10((c + ALPHA) / (total + ALPHA * (v + 1))), np.log10(p))]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": remainder(ids) == HELD_OUT, "n_tokens": unit.lengths, "n_known": sums[0].astype(np.int64), "train_tokens": total, "base_score": sums[1], "score": sums[2]})

    return units.select("unit", "rows").groupBy("unit").cogroup(replies.drop("fold").groupBy("unit")).applyInPandas(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op10(docs: DataFrame) -> DataFrame:
    return score(docs)
