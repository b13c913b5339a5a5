"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are lower-cased runs of letters and digits; punctuation parts them. An item of L words is compared with windows
of L words (a shorter document is one window). Both are multisets of shingles of WIDTH words (of L, where an item is
shorter), and their weighted similarity is the sum of the smaller counts over the sum of the larger; THRESHOLD or more
is a match. A window that shares no shingle with an item has similarity 0, so only windows over a shared shingle are
fingerprinted, with BITS bits. Fingerprints meet the items' through 8 blocks of 16 bits: of two within RADIUS bits, some block
differs by no more than its share of REACH (these are chosen so that more than RADIUS bits differ if every block exceeds
its own). A length with many items has posting lists: for each block value the items that have it. A window looks up all
values within a block's reach, which reads one item in seven, and what it finds is measured by all bits. Lists of fewer than
LONG items are measured as they are, which is cheaper than the look-ups; either way all items within RADIUS are found and
no other, and only these are compared by their shingles: of unrelated windows fewer than one in a thousand, with a thousand
items of one length. RADIUS is three and a quarter standard deviations beyond the distance expected at THRESHOLD; the
recall at THRESHOLD is tested.

The items come to the tasks in slices of about SLICE bytes, one pass over the documents a slice; a Python worker indexes a
slice once. The driver holds the items' texts, no more. Null text counts as empty; an item without words matches nothing,
nor does a document without words. Repeated rows give repeated matches, rows with a null doc_id too; extra columns are
ignored; an empty benchmark or no documents give no matches."""

import functools
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from turnwise.llm.common import PUNCTUATION, Words, mix, runs, shingles

WIDTH, THRESHOLD, BITS, RADIUS, SLICE = 5, 0.8, 128, 33, 4 << 20
#: Bits by which a block may differ: sum of (reach + 1) is RADIUS + 1, so that one block at least keeps within its own.
REACH = (4, 4, 3, 3, 3, 3, 3, 3)
#: Items of one length that are worth posting lists; pairs that are measured at once.
LONG, PAIRS = 2048, 1 << 20
_FILTER = 1 << 22
#: Every 16-bit value with so many ones or fewer: a block's neighbours are its value with one of these flipped.
_FLIPS = {r: np.array([sum(1 << b for b in bits) for k in range(r + 1) for bits in itertools.combinations(range(16), k)], np.uint16) for r in set(REACH)}
#: Words of one stretch that are fingerprinted at once.
_STRETCH = 1 << 14


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts).cast(pa.large_binary()), parted_by=PUNCTUATION)


def simhash(rows: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the multisets rows[s : s + size], BITS bits as 64-bit numbers."""
    wide = np.stack([rows, *(mix(rows + np.uint64(k)) for k in range(1, BITS // 64))], 1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    total = np.zeros((len(rows) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    ones = total[starts + size] - total[starts]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / max(1, a.total() + b.total() - both)


def _blocks(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)


def posting_lists(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block: where each value's items begin, and the items by value."""
    lists = []
    for values in _blocks(prints).T:
        order = np.argsort(values, kind="stable").astype(np.int32)
        lists.append((np.searchsorted(values[order], np.arange((1 << 16) + 1)).astype(np.int32), order))
    return lists


def looked_up(lists: list[tuple[np.ndarray, np.ndarray]], prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) that agree in some block to within its reach, once each."""
    keys, blocks = [], _blocks(prints)
    for (begins, order), reach, values in zip(lists, REACH, blocks.T, strict=True):
        near = (values[:, None] ^ _FLIPS[reach]).astype(np.int64)
        size = begins[near + 1] - begins[near]
        win = np.repeat(np.arange(len(prints)), size.sum(1))
        flat, count = begins[near].ravel(), size.ravel()
        at = np.repeat(flat - (np.cumsum(count) - count), count) + np.arange(count.sum())
        keys.append(win * n + order[at])
    return np.divmod(np.unique(np.concatenate(keys)), n)


class Index:
    """Items by length: their shingles, fingerprints and, where there are many, posting lists; and the lengths of the items that hold a shingle."""

    def __init__(self, items: list[tuple]):
        items = [i for i in items if i[1]]
        w = _words(pa.array([t for _, t in items], pa.string()))
        h = w.hashes()
        self.sizes: dict[int, dict] = {}
        places = defaultdict(list)
        for k, (item, _) in enumerate(items):
            own = h[w.first[k] : w.first[k + 1]]
            n = len(own)
            if not n:
                continue
            width = min(WIDTH, n)
            s = shingles(own, np.array([0, n]), width)[0][: n - width + 1]
            size = self.sizes.setdefault(n, {"ids": [], "bags": [], "prints": []})
            size["ids"].append(item)
            size["bags"].append(Counter(s.tolist()))
            size["prints"].append(simhash(s, np.array([0]), len(s))[0])
            for x in s.tolist():
                places[width, x].append(n)
        self.widths = {}
        for width in {k for k, _ in places}:
            keys = np.array(sorted(x for k, x in places if k == width), np.uint64)
            seen = np.zeros(_FILTER, bool)
            seen[(keys & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.widths[width] = keys, seen, {x: sorted(set(v)) for (k, x), v in places.items() if k == width}
        for size in self.sizes.values():
            size["prints"] = np.array(size["prints"], np.uint64)
            size["lists"] = posting_lists(size["prints"]) if len(size["prints"]) >= LONG else None

    @staticmethod
    def candidates(size: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, differing bits) of the fingerprints within RADIUS."""
        items, lists = size["prints"], size["lists"]
        step, found = max(1, PAIRS // len(items)), []
        for lo in range(0, len(prints), step):
            some = prints[lo : lo + step]
            if lists is None:
                win, item = np.divmod(np.arange(len(some) * len(items)), len(items))
            else:
                win, item = looked_up(lists, some, len(items))
            far = np.bitwise_count(some[win] ^ items[item]).sum(1, dtype=np.int64)
            use = far <= RADIUS
            found.append((win[use] + lo, item[use], far[use]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def matches(self, texts: pa.Array) -> list[tuple[int, object, int, int, int, float]]:
        """(text, item, first word, words, differing bits, similarity): the best window of each item in each text."""
        w = _words(texts)
        h, best = w.hashes(), {}
        for width, (keys, seen, places) in self.widths.items():
            s, inside = shingles(h, w.first, width)
            hit = np.flatnonzero(inside & seen[(s & np.uint64(_FILTER - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, s[hit]), len(keys) - 1)
            hit = hit[keys[at] == s[hit]]
            doc = np.searchsorted(w.first, hit, "right") - 1
            over = defaultdict(list)
            for p, d in zip(hit.tolist(), doc.tolist(), strict=True):
                for n in places[int(s[p])]:
                    over[d, n].append(p)
            for (d, n), found in over.items():
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                size = min(n, hi - lo)
                k, p = size - width + 1, np.array(found)
                first, last = np.maximum(p - k + 1, lo), np.minimum(p, hi - size)
                edge = np.zeros(hi - lo + 2, np.int32)
                np.add.at(edge, first - lo, 1)
                np.add.at(edge, last - lo + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge) > 0)
                cut = np.flatnonzero((np.diff(starts) > n) | (np.diff(starts // _STRETCH) > 0)) + 1
                bag = self.sizes[n]
                for group in np.split(starts, cut):
                    part = s[lo + group[0] : lo + group[-1] + k]
                    for w_, i, far in zip(*(x.tolist() for x in self.candidates(bag, simhash(part, group - group[0], k))), strict=True):
                        start = int(group[w_])
                        have = similarity(Counter(part[start - group[0] : start - group[0] + k].tolist()), bag["bags"][i])
                        if have >= THRESHOLD and ((d, n, i) not in best or have > best[d, n, i][3]):
                            best[d, n, i] = start, size, far, have
        return [(d, self.sizes[n]["ids"][i], *v) for (d, n, i), v in best.items()]


def slices(benchmark: DataFrame) -> list[DataFrame]:
    """Parts of the benchmark of about SLICE bytes each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _items(part: DataFrame) -> tuple[tuple, ...]:
    return tuple(sorted(((r.item_id, r.text) for r in part.collect()), key=repr))


@functools.lru_cache(1)
def _index(items: tuple[tuple, ...]) -> Index:
    """The slice's index, built once by a Python worker that meets it in several tasks."""
    return Index(list(items))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity: one row for each item that a document holds. No shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance int, similarity double"
    out = None
    for part in slices(benchmark):
        items = _items(part)

        def matched(batches, items=items):
            index = _index(items)
            for batch in batches:
                for lo, hi in runs(batch.column(1)):
                    some = batch.slice(lo, hi - lo)
                    found = index.matches(some.column(1))
                    ids = some.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.float64())))], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        rows = texts.mapInArrow(matched, schema)
        out = rows if out is None else out.union(rows)
    return out


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their own columns; judged in the scan, so ids may repeat."""
    names = docs.columns
    for part in slices(benchmark):
        items = _items(part)
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce("text", F.lit("")).alias("t"))

        def judged(batches, items=items):
            index = _index(items)
            for batch in batches:
                hit = np.zeros(len(batch), bool)
                for lo, hi in runs(batch.column(1)):
                    hit[[lo + f[0] for f in index.matches(batch.column(1).slice(lo, hi - lo))]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], names=["row", "hit"])

        docs = rows.mapInArrow(judged, StructType([rows.schema["row"], StructField("hit", BooleanType())])).where(~F.col("hit")).select("row.*")
    return docs


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark)
