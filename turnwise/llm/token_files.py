"""Token-id files: patched frame-of-reference blocks.

A file holds whole documents. Its ids are cut into blocks of BLOCK; a block keeps its minimum, the residuals packed at
the width that the WIDTH_PERCENTILE of them needs, and an exception list (place, residual) for those that need more.
The starts of all blocks are indexed, so a slice of ids decodes only the blocks it touches.

Layout, little-endian: magic "PFR1", n_docs u32, n_ids u64, n_blocks u32; doc ids i64[n_docs] and lengths u32[n_docs];
block starts u64[n_blocks + 1] (bytes after the header); each block: minimum u32, width u8, n_exceptions u8, the packed
residuals (16 * width bytes), places u8[], residuals u32[].

Files are rows of a Parquet table (part, seq, file): Spark's commit protocol makes the write safe against lost
executors and any store Spark writes to will do. Documents are range-partitioned by doc_id, so that part and seq follow
ascending doc_id; a file closes at FILE_IDS ids, at a document's end. Ties of doc_id are put in order of a hash of their text, then the text.
Null text encodes as the end id alone; a null doc_id sorts first and comes back as null (so does -2^63, which stands for it in a file); repeated rows are encoded each.
An empty table gives no files; other columns are not read."""

import functools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import durable, runs, whole_text

BLOCK, WIDTH_PERCENTILE, FILE_IDS, END = 128, 90, 1 << 18, 1
#: Pieces in each of the two generations of a worker's cache.
CACHE_PIECES = 400_000
#: Bytes of text encoded at once.
ENCODE = 1 << 21
#: Fixed value: the pattern of the tokenizers whose pieces may be encoded together.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: PLAIN characters are ASCII and the letters of Latin-1 and Latin Extended-A but for U+0130; composed and lower-cased alike
#: everywhere. A special token may begin at "<|". Between words stands ASCII white space. PIECES is SPLIT for plain text.
NOT_PLAIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-įı-ſ]").search
BETWEEN = re.compile(r"[^\t-\r ]+").findall
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-zß-öø-ſ0-9]+").findall
_HEAD = struct.Struct("<4sIQI")
_NULL = -(2**63)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ids (below 2^32), and where each starts (and the end)."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    low = full.min(1) if n else np.empty(0, np.uint32)
    rest = full - low[:, None]
    at = BLOCK * WIDTH_PERCENTILE // 100
    limit = np.partition(rest, at, axis=1)[:, at] if n else low
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(1).astype(np.uint8)
    body: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        inner = np.where(over[rows], np.uint32(0), rest[rows]).astype("<u4", copy=False)
        bits = np.unpackbits(inner.view(np.uint8).reshape(-1, 4), axis=1, count=w, bitorder="little")
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").tobytes()
        for k, r in enumerate(rows.tolist()):
            body[r] = packed[k * 16 * w : (k + 1) * 16 * w]
    places, values = np.nonzero(over)[1].astype(np.uint8).tobytes(), rest[over].astype("<u4").tobytes()
    cut = np.concatenate([[0], np.cumsum(n_over, dtype=np.int64)])
    blocks = [struct.pack("<IBB", int(low[r]), int(width[r]), int(n_over[r])) + body[r] + places[cut[r] : cut[r + 1]] + values[4 * cut[r] : 4 * cut[r + 1]] for r in range(n)]
    return b"".join(blocks), np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype("<u8")


def unpack(blocks: bytes, starts: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (end exclusive)."""
    last = len(starts) - 1 if last is None else last
    out = np.empty((last - first, BLOCK), np.uint32)
    raw, s = np.frombuffer(blocks, np.uint8), starts[first:last].astype(np.int64)
    head = raw[s[:, None] + np.arange(6)] if len(s) else np.empty((0, 6), np.uint8)
    low, width, n_over = np.ascontiguousarray(head[:, :4]).view("<u4").ravel(), head[:, 4], head[:, 5]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = raw[s[rows][:, None] + 6 + np.arange(16 * w)]
        bits = np.zeros((len(rows) * BLOCK, 32), np.uint8)
        bits[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows) * BLOCK, w)
        out[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
    for r in np.flatnonzero(n_over).tolist():
        at, k = int(s[r]) + 6 + 16 * int(width[r]), int(n_over[r])
        out[r, raw[at : at + k]] = np.frombuffer(blocks, "<u4", k, at + k)
    return (out + low[:, None]).ravel()


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks, starts = pack(ids)
    keys = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    return _HEAD.pack(b"PFR1", len(doc_ids), len(ids), len(starts) - 1) + keys.tobytes() + np.array(lengths, "<u4").tobytes() + starts.tobytes() + blocks


def read_index(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, lengths, block starts and where the blocks begin."""
    magic, n_docs, _, n_blocks = _HEAD.unpack_from(file)
    if magic != b"PFR1":
        raise ValueError("not a token file")
    at = _HEAD.size
    docs = np.frombuffer(file, "<i8", n_docs, at)
    lengths = np.frombuffer(file, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    starts = np.frombuffer(file, "<u8", n_blocks + 1, at + 12 * n_docs)
    return docs, lengths, starts, at + 12 * n_docs + 8 * (n_blocks + 1)


def read_slice(file: bytes, start: int, stop: int) -> np.ndarray:
    """ids start to stop of a file; only the blocks that hold them are decoded."""
    _, _, starts, at = read_index(file)
    first, last = start // BLOCK, min(-(-stop // BLOCK), len(starts) - 1)
    return unpack(file[at:], starts, first, last)[start - first * BLOCK : stop - first * BLOCK] if stop > start else np.empty(0, np.uint32)


class Encoder:
    """Encodes texts piece by piece through a bounded cache.

    Where the tokenizer splits by SPLIT, lower-cases and marks the last id of a piece (a suffix in its vocabulary), texts of
    PLAIN characters are split here by the same pattern, and new pieces are encoded many at a time, parted by white space
    and cut behind the marked ids; neither the normaliser nor the splitter need run for them. Words with other characters,
    and all words of other tokenizers, are encoded alone: the tokenizer's rules never join what white space parts."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.pieces, self.words = Tokenizer.from_file(tokenizer), Generations(CACHE_PIECES), Generations(CACHE_PIECES // 8)
        rules = json.loads(self.tokenizer.to_str())
        model, split = rules["model"], json.dumps(rules["pre_tokenizer"])
        suffix, self.last = model.get("end_of_word_suffix"), None
        if suffix and json.dumps(SPLIT) in split and '"ByteLevel"' in split and '"Lowercase"' in json.dumps(rules["normalizer"]):
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=suffix, cache_capacity=0))
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ascii = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=suffix, cache_capacity=0))
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # printable ASCII stands for its own bytes
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def _encode_words(self, words: list[str]) -> None:
        for lo in range(0, len(words), 2_000):
            part = words[lo : lo + 2_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words.young[w] = np.array(e.ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> None:
        own = [p for p in pieces if p.isascii() and p.isprintable()]
        self._encode_by(self.ascii, own)
        if len(own) < len(pieces):
            self._encode_by(self.bare, list(set(pieces).difference(own)))

    def _encode_by(self, tokenizer, pieces: list[str]) -> None:
        for lo in range(0, len(pieces), 4_000):
            part = pieces[lo : lo + 4_000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.pieces.young.update(zip(part, map(raw.__getitem__, map(slice, [0, *cut], cut)), strict=True))

    def _plain(self, text: str) -> bool:
        return self.last is not None and "<|" not in text and (text.isascii() or not NOT_PLAIN(text))

    def _split(self, text: str) -> tuple[list[str], list[tuple[int, str]]]:
        """Pieces, and (place among them, word) of the words to be encoded alone."""
        if self._plain(text):
            return PIECES(text.lower()), []
        pieces, alone = [], []
        for w in BETWEEN(text):
            if self._plain(w):
                pieces += PIECES(w.lower())
            else:
                alone.append((len(pieces), w))
        return pieces, alone

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self._split(t.decode()) for t in texts]
        self._encode_pieces(self.pieces.lacks(set().union(*(p for p, _ in split))))
        self._encode_words(self.words.lacks({w for _, alone in split for _, w in alone}))
        get, word, out = self.pieces.young.__getitem__, self.words.young, []
        for pieces, alone in split:
            if not alone:
                out.append(b"".join(map(get, pieces)))
                continue
            parts, at = [], 0
            for place, w in alone:
                parts += map(get, pieces[at:place])
                parts.append(word[w])
                at = place
            out.append(b"".join(parts + list(map(get, pieces[at:]))))
        return out


class Generations:
    """A cache of two generations: what the young one lacks may come from the old one, which a full young one replaces."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def lacks(self, keys: set) -> list:
        """Those of keys that neither generation has; the others are in the young one afterwards."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        need = keys - self.young.keys()
        known = need & self.old.keys()
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(need - known)


@functools.cache
def _encoder(tokenizer: str) -> Encoder:
    """One encoder a Python worker, so that its cache outlives a task."""
    return Encoder(tokenizer)


def encode_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(part, seq, n_ids, before, file): the token files of docs, in ascending doc_id by part and seq; before counts the ids of the part's earlier files."""

    def write(batches):
        from pyspark import TaskContext

        part, seq, before, encode = TaskContext.get().partitionId(), 0, 0, _encoder(tokenizer)
        keys, lengths, ids, held = [], [], [], 0
        mark = np.array([end], "<u4").tobytes()

        def close():
            nonlocal keys, lengths, ids, held, seq, before
            file = write_file(keys, lengths, np.frombuffer(b"".join(ids), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([before], pa.int64()), pa.array([file], pa.binary())], names=["part", "seq", "n_ids", "before", "file"])
            keys, lengths, ids, held, seq, before = [], [], [], 0, seq + 1, before + held
            return row

        for batch in batches:
            for lo, hi in runs(batch.column(1), ENCODE):
                some = batch.slice(lo, hi - lo)
                for key, b in zip(some.column(0).to_pylist(), encode(some.column(1).cast(pa.large_binary()).to_pylist()), strict=True):
                    keys.append(key)
                    ids += [b, mark]
                    lengths.append(len(b) // 4 + 1)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        yield close()
        if keys:
            yield close()

    in_order = whole_text(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return in_order.mapInArrow(write, "part int, seq int, n_ids bigint, before bigint, file binary")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone. The files are not shuffled: the totals of
    the parts, a row a partition of the write, are broadcast."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = F.broadcast(sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier")))

    def read(batches):
        for batch in batches:
            for start, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, lengths, starts, at = read_index(file)
                ids = unpack(file[at:], starts).astype("<u4")
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NULL), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(parts, "part").select((F.col("earlier") + F.col("before")).alias("start"), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_documents(durable(encode_files(docs, tokenizer or tokenizer_path()), "tokens"))
