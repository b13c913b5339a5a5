"""WAV recordings as a Spark data source: spark.read.format("wav"), df.write.format("wav") and writeStream.format("wav").

Reading deals byte ranges of a file to tasks, so a recording of several GB is read by many and many short ones share a task; a range is brought down to a
lower rate with the samples of its neighbours that the filter reaches. Conditions on idx narrow the ranges that are read at all
(with the option pushdown, which asks for spark.sql.python.filterPushdown.enabled). 16-bit PCM of one or two channels is understood, plain or extensible,
and RF64 beyond 4 GB; a recording whose header was never finished is read to its end.

Writing puts every sample at its own place of the file, whichever task has it, so no task or row holds a session, a task that
runs twice writes the same bytes, and samples that nobody has are silence. A batch write shows a file when it is committed; a
stream's commit of a batch renews the headers, so a crash leaves a recording that can be read, and a batch that is run again after a
restart changes nothing. The folder is to be mounted by all executors (places can't be written in object stores);
reading takes any URI that Arrow's file systems know."""

import os
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from turnwise.operators.signal import sinc_kernel

#: Frames of a range, frames of a batch, files that a task keeps open.
SPLIT, BATCH, OPEN = 1 << 22, 1 << 16, 64
#: Ranges share a task up to so many frames, each counting at least LEAST for the opening of its file.
SHARE, LEAST = 1 << 18, 1 << 8
#: Bytes before the samples in files written here: room for the 64-bit sizes of RF64.
HEADER = 80
_LARGEST = 2**32 - 1 - HEADER


class Header(NamedTuple):
    rate: int
    channels: int
    begin: int
    frames: int


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def read_header(file: pa.NativeFile, name: str = "") -> Header:
    """A WAV file's format and where its samples are; ValueError for what isn't 16-bit PCM of one or two channels."""
    size, at, form, wide = file.size(), 12, None, None
    head = file.read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError(f"{name}: no WAV file")
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", file.read_at(8, at))
        at += 8
        if kind == b"ds64":
            wide = struct.unpack("<QQ", file.read_at(16, at))[1]
        elif kind == b"fmt ":
            raw = file.read_at(min(length, 40), at)
            if len(raw) < 16:
                break
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            tag = struct.unpack("<H", raw[24:26])[0] if tag == 0xFFFE and len(raw) >= 26 else tag
            if tag != 1 or bits != 16 or channels not in (1, 2) or not rate:
                raise ValueError(f"{name}: expected 16-bit PCM of one or two channels, got {channels} of {bits} bits, format {tag}")
            form = rate, channels
        elif kind == b"data":
            if form is None:
                break
            length = wide if length == 2**32 - 1 and wide is not None else length
            whole = size - at
            length = min(length, whole) if length not in (0, 2**32 - 1) else whole
            return Header(*form, at, length // (2 * form[1]))
        at += length + length % 2
    raise ValueError(f"{name}: format or samples are missing")


def header_bytes(rate: int, channels: int, frames: int) -> bytes:
    data = 2 * channels * frames
    wide = data > _LARGEST
    size = 2**32 - 1 if wide else data + HEADER - 8
    room = struct.pack("<QQQI", data + HEADER - 8, data, frames, 0)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, 2 * rate * channels, 2 * channels, 16)
    return struct.pack("<4sI4s", b"RF64" if wide else b"RIFF", size, b"WAVE") + struct.pack("<4sI", b"ds64" if wide else b"JUNK", 28) + room + form + struct.pack("<4sI", b"data", 2**32 - 1 if wide else data)


@dataclass
class Span:
    """Output samples low to high of a file."""

    path: str
    header: Header
    low: int
    high: int


@dataclass
class Share(InputPartition):
    """The ranges that a task reads, one after another."""

    spans: list[Span]


def _shares(spans: list[Span]) -> list[Share]:
    """Neighbouring ranges put together, so that many short recordings don't make as many tasks."""
    out, room = [], 0
    for span in spans:
        cost = max(span.high - span.low, LEAST)
        if cost > room:
            out.append(Share([]))
            room = SHARE
        out[-1].spans.append(span)
        room -= cost
    return out


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channel = options["path"], options.get("channel", "both")
        self.target, self.split = int(options.get("targetRate", 0)), int(options.get("splitFrames", SPLIT))
        self.low, self.high = 0, 2**63 - 1
        if self.channel not in ("both", "mic", "system"):
            raise ValueError(f"no channel {self.channel}")
        if self.split < 1:
            raise ValueError("splitFrames must be 1 or more")

    def _factor(self, header: Header, path: str) -> int:
        to = self.target or header.rate
        if header.rate % to:
            raise ValueError(f"{path}: {header.rate} Hz can't be brought down to {to} Hz")
        return header.rate // to

    def partitions(self) -> list[Share]:
        fs, root = locate(self.path)
        found = fs.get_file_info(root)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [root] if found.is_file else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.lower().endswith(".wav") and i.base_name[0] != ".")

        def header(name):
            with fs.open_input_file(name) as file:
                return read_header(file, name)

        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(header, names))
        spans = []
        for name, h in zip(names, headers, strict=True):
            n = -(-h.frames // self._factor(h, name))
            spans += [Span(name, h, k, min(k + self.split, n, self.high)) for k in range(self.low, min(n, self.high), self.split)]
        return _shares(spans) or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        """Short batches of several ranges are sent as one."""
        held, n = [], 0
        for span in share.spans:
            for batch in self._batches(span):
                if held and n + len(batch) > BATCH:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
                held.append(batch)
                n += len(batch)
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, span: Span) -> Iterator[pa.RecordBatch]:
        h, factor = span.header, self._factor(span.header, span.path)
        taps = np.array(sinc_kernel(factor))[::-1] if factor > 1 else np.ones(1)
        half, width = len(taps) // 2, 2 * h.channels
        fs, _ = locate(self.path)
        with fs.open_input_file(span.path) as file:
            for low in range(span.low, span.high, BATCH):
                high = min(low + BATCH, span.high)
                first, last = low * factor - half, (high - 1) * factor + half + 1
                begin, end = max(first, 0), min(last, h.frames)
                raw = np.frombuffer(file.read_at((end - begin) * width, h.begin + begin * width), "<i2").reshape(-1, h.channels)
                columns = []
                for name, k in (("mic", 0), ("system", 1)):
                    if self.channel not in ("both", name):
                        continue
                    if k >= h.channels:
                        columns.append((name, pa.nulls(high - low, pa.float32())))
                        continue
                    x = raw[:, k].astype(np.float32) / np.float32(32768)
                    if factor > 1:
                        x = np.pad(x.astype(float), (begin - first, last - end))
                        x = (np.lib.stride_tricks.sliding_window_view(x, len(taps))[::factor] @ taps).astype(np.float32)
                    columns.append((name, pa.array(x, pa.float32())))
                n, rate = high - low, pa.scalar(h.rate // factor, pa.int32())
                names = ["path", "rate", "channels", "idx", *(c for c, _ in columns)]
                yield pa.RecordBatch.from_arrays([pa.repeat(span.path, n), pa.repeat(rate, n), pa.repeat(pa.scalar(h.channels, pa.int32()), n), pa.array(np.arange(low, high)), *(c for _, c in columns)], names=names)


class PushingWavReader(WavReader):
    """Spark refuses readers of this kind where its conditions aren't to be pushed down."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if getattr(f, "attribute", None) == ("idx",):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f  # Spark asks again; the rows of a range's ends aren't cut here


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: rows and one more than the last place, by session."""

    sessions: dict


class Places:
    """Open files of a task, into which runs of samples are put at their places."""

    def __init__(self, path_of, channels: int):
        self.path_of, self.channels, self.open, self.seen = path_of, channels, OrderedDict(), {}

    def _file(self, session: str) -> int:
        if session not in self.open:
            if len(self.open) >= OPEN:
                os.close(self.open.popitem(last=False)[1])
            self.open[session] = os.open(self.path_of(session), os.O_CREAT | os.O_WRONLY, 0o644)
        self.open.move_to_end(session)
        return self.open[session]

    def put(self, batch: pa.RecordBatch) -> None:
        names = batch.column(batch.schema.get_field_index("session_id")).cast(pa.string()).to_numpy(zero_copy_only=False).astype(str)
        at = batch.column(batch.schema.get_field_index("idx")).cast(pa.int64())
        for session in np.unique(names[np.asarray(at.is_null())]):  # a row without a place only names its session
            self._file(session)
            self.seen.setdefault(session, (0, 0))
        rows = np.flatnonzero(np.asarray(at.is_valid()))
        if not len(rows):
            return
        names, at = names[rows], at.drop_null().to_numpy()
        if at.min() < 0:
            raise ValueError("a sample's place is below 0")
        x = np.stack([np.nan_to_num(np.array(batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False), float)[rows]) for c in ("mic", "system")[: self.channels]], 1)
        pcm = (np.clip(x, -1, 1) * 32767).astype("<i2")
        order = np.lexsort((at, names))
        names, at, pcm = names[order], at[order], pcm[order]
        cuts = np.flatnonzero((names[1:] != names[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            session, data, place = str(names[lo]), memoryview(pcm[lo:hi].tobytes()), HEADER + int(at[lo]) * 2 * self.channels
            file = self._file(session)
            while data:
                done = os.pwrite(file, data, place)
                data, place = data[done:], place + done
            n, last = self.seen.get(session, (0, 0))
            self.seen[session] = n + hi - lo, max(last, int(at[hi - 1]) + 1)

    def close(self) -> Written:
        for file in self.open.values():
            os.close(file)
        return Written(self.seen)


def _finish(path: str, rate: int, channels: int, frames: int) -> None:
    with open(path, "r+b") as file:
        file.write(header_bytes(rate, channels, frames))
        file.truncate(HEADER + 2 * channels * frames)
        file.flush()
        os.fsync(file.fileno())


def _totals(messages: list) -> dict[str, tuple[int, int]]:
    total: dict = {}
    for m in messages:
        for session, (n, last) in (m.sessions if m else {}).items():
            have = total.get(session, (0, 0))
            total[session] = have[0] + n, max(have[1], last)
    return total


class _Sink:
    def __init__(self, options: dict, schema):
        if "path" not in options or int(options.get("rate", 0)) < 1:
            raise ValueError("path and rate are to be given")
        self.folder, self.rate = locate(options["path"])[1], int(options["rate"])
        names = schema.fieldNames()
        if not {"session_id", "idx", "mic"} <= set(names):
            raise ValueError("columns session_id, idx, mic and, for stereo, system are expected")
        self.channels = 2 if "system" in names else 1
        os.makedirs(self.folder, exist_ok=True)

    def final(self, session: str) -> str:
        if not session or "/" in session or session[0] == ".":
            raise ValueError(f"{session!r} can't name a recording")
        return f"{self.folder}/{session}.wav"

    def _put_all(self, batches, path_of) -> Written:
        places = Places(path_of, self.channels)
        for batch in batches:
            places.put(batch)
        return places.close()


class WavWriter(_Sink, DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options, schema)
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _part(self, session: str) -> str:
        return f"{self.folder}/.{self.job}-{os.path.basename(self.final(session))}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return self._put_all(batches, self._part)

    def commit(self, messages: list) -> None:
        total = _totals(messages)
        for session, (n, frames) in total.items():
            if n > frames:
                raise ValueError(f"{session}: a place has more than one sample")
            if not self.overwrite and os.path.exists(self.final(session)):
                raise FileExistsError(self.final(session))
        with ThreadPoolExecutor(16) as pool:  # they mostly wait for the disk
            list(pool.map(lambda item: _finish(self._part(item[0]), self.rate, self.channels, item[1][1]), total.items()))
        for session in total:
            os.replace(self._part(session), self.final(session))

    def abort(self, messages: list) -> None:
        for name in os.listdir(self.folder):
            if name.startswith(f".{self.job}-"):
                os.remove(f"{self.folder}/{name}")


class WavStreamWriter(_Sink, DataSourceStreamArrowWriter):
    """A recording's file is hidden until the first commit writes its header."""

    def _path(self, session: str) -> str:
        at = self.final(session)
        return at if os.path.exists(at) else f"{self.folder}/.open-{session}.wav"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return self._put_all(batches, self._path)

    def commit(self, messages: list, batchId: int) -> None:
        for session, (_, frames) in _totals(messages).items():
            at = self._path(session)
            if at == self.final(session):
                with pa.OSFile(at) as file:
                    frames = max(frames, read_header(file, at).frames)
            _finish(at, self.rate, self.channels, frames)
            os.replace(at, self.final(session))

    def abort(self, messages: list, batchId: int) -> None:
        """What was written lies beyond the header's end and is written again."""


class WavDataSource(DataSource):
    """Options to read: path, channel (mic or system alone), targetRate, splitFrames, pushdown. To write: path, rate.

    Rows read: path, rate, channels, idx and the samples mic and system (null in mono files). Rows written: session_id (the file's
    name), idx, mic and perhaps system; a null sample is silence, a null idx only names its session."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        channel = self.options.get("channel", "both")
        samples = ", ".join(f"{c} float" for c in ("mic", "system") if channel in ("both", c))
        return f"path string, rate int, channels int, idx long, {samples}"

    def reader(self, schema) -> WavReader:
        return (PushingWavReader if self.options.get("pushdown") == "true" else WavReader)(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, schema, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> WavStreamWriter:
        return WavStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavDataSource)


def read_tracks(spark: SparkSession, path: str, target_rate: int | None = None, channel: str = "both", split: int = SPLIT) -> DataFrame:
    """session_id (a hash of the path), path, rate, channels, idx and samples of all WAV files under path."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("wav").options(channel=channel, splitFrames=split, targetRate=target_rate or 0, pushdown=pushed).load(path)
    return rows.select(F.xxhash64("path").alias("session_id"), "*")


def write_tracks(tracks: DataFrame, path: str, rate: int, overwrite: bool = False) -> None:
    """A WAV file a session of tracks (session_id, idx, mic and perhaps system). Rows are dealt by ranges of (session, place), so a
    long session is written by many tasks, each in long runs."""
    register(tracks.sparkSession)
    names = [c for c in ("session_id", "idx", "mic", "system") if c in tracks.columns]
    rows = tracks.select(*names).repartitionByRange("session_id", "idx").sortWithinPartitions("session_id", "idx")
    rows.write.format("wav").option("rate", rate).mode("overwrite" if overwrite else "append").save(path)


def record_wav(aligned: DataFrame, path: str, checkpoint: str, rate: int, trigger: dict | None = None):
    """Starts the recorder: a stream of samples (session_id, idx, mic and perhaps system) goes to a WAV file a session."""
    register(aligned.sparkSession)
    names = [c for c in ("session_id", "idx", "mic", "system") if c in aligned.columns]
    writer = aligned.select(*names).writeStream.format("wav").option("rate", rate).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start(path)
