"""Boundaries of segments, intervals, sessions and signals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import intervals, segments, sessions, signal, spectral
from turnwise.plans import recordings, summaries
from turnwise.sources import wav
from turnwise.streaming import stateful

SEG = "session_id long, seq long, channel string, start double, end double, text string"
TURN = "session_id long, turn_idx int, start double, end double, speaker int"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "norm"), [("  Hello, World! ", "hello world"), ("　Ünïcode… ", "ünïcode"), ("a b", "a b"), ("", "")])
def test_normalize(spark, text, norm):
    assert one(spark, T.normalize, text) == norm


@pytest.mark.parametrize(("s", "out"), [(75.9, "1:15"), (3725.0, "1:02:05"), (0.0, "0:00")])
def test_timestamp(spark, s, out):
    assert one(spark, T.format_timestamp, s, "double") == out


@pytest.mark.parametrize(("s", "out"), [(2880, "48m"), (3900, "1h 5m"), (7200, "2h"), (-10, "0m")])
def test_duration(spark, s, out):
    assert one(spark, T.format_duration, s, "long") == out


def test_hallucinations(spark):
    rows = [("ok", 0.6, 2.4, True), ("ok", 0.61, 0.0, False), ("ok", 0.0, 2.41, False), ("ok", float("nan"), None, True), ("ok", None, None, True), ("Thanks.", 0.0, 0.0, True), ("Thank you!", 0.0, 0.0, False), ("底", 0.0, 0.0, False), ("thank you so much for that update", 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "text string, no_speech_prob double, compression_ratio double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", ~segments.is_hallucination()).collect())


def test_assign_speakers(spark):
    segs = spark.createDataFrame([(1, 0, "system", 10.0, 12.0, "touching"), (1, 1, "system", 9.0, 16.0, "straddles"), (1, 2, "system", 5.0, 15.0, "tie"), (1, 3, "system", 3.0, 3.0, "empty"), (1, 4, "system", 300.0, 301.0, "none")], SEG)
    turns = spark.createDataFrame([(1, 0, 0.0, 10.0, 0), (1, 1, 10.0, 20.0, 1)], TURN)
    for width in (1.0, 7.0, 1000.0):
        assert {r.seq: r.speaker for r in intervals.assign_speakers(segs, turns, width).collect()} == {0: 1, 1: 1, 2: 0, 3: None, 4: None}
    assert {r.speaker for r in intervals.assign_speakers(segs, turns.limit(0)).collect()} == {None}


def test_drop_bleed(spark):
    rows = [(1, 0, "mic", 0.0, 5.0, "Hello there!"), (1, 1, "system", 1.0, 4.0, "hello there"), (1, 2, "mic", 50.0, 55.0, "hello there"), (1, 3, "mic", 1.0, 4.0, "other words"), (1, 4, "mic", 1.0, 2.0, "..."), (1, 5, "mic", 2.0, 2.0, "hello there")]
    left = intervals.drop_bleed(spark.createDataFrame(rows, SEG), lambda a, b: a == b, 3.0)
    assert sorted(r.seq for r in left.collect()) == [1, 2, 3, 4]
    left = intervals.drop_bleed(spark.createDataFrame(rows, SEG), lambda a, b: T.text_ratio(a, b) >= 0.6, 3.0)
    assert sorted(r.seq for r in left.collect()) == [1, 2, 3, 4]


def test_text_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    assert df.select(T.text_ratio("a", "b"), T.text_ratio("b", "a")).first() == (0.25, 0.5)


def test_render_without_segments(spark):
    empty = spark.createDataFrame([], SEG + ", speaker string")
    assert segments.render(empty, spark.range(1).withColumnRenamed("id", "session_id")).first().transcript == "# Transcript\n"


@pytest.mark.parametrize(("counts", "budget", "windows"), [([5, 5, 1], 10, [0, 0, 1]), ([50, 1], 10, [0, 1]), ([1, 1, 1], -5, [0, 1, 2])])
def test_pack(spark, counts, budget, windows):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(counts)], "k long, o long, c long")
    assert [r.window_id for r in sessions.pack(df, "k", "o", "c", budget).orderBy("o").collect()] == windows


def _watch(mic, system, stop, poll=0.25):
    """A plain state machine of the watchdog."""
    thr, silence, armed = None, 0.0, False
    for i, (m, s) in enumerate(zip(mic, system, strict=True)):
        if i < 12:
            thr = max(sorted(mic[:12])[6] * 4, 1e-3)
            continue
        act = m > thr or (s is not None and s > 5e-4)
        armed = armed or act
        silence = 0.0 if act or not armed else silence + poll
        if silence >= stop:
            return i
    return None


def _sessions(rng, n):
    rows, want = [], {}
    for k in range(n):
        mic = rng.choice([1e-5, 2e-4, 0.01], size=40, p=[0.5, 0.42, 0.08]).tolist()
        system = [None if rng.random() < 0.5 else float(rng.choice([1e-4, 1e-3], p=[0.9, 0.1])) for _ in mic]
        rows += [(k, i, m, s) for i, (m, s) in enumerate(zip(mic, system, strict=True))]
        if (stop := _watch(mic, system, 2.0)) is not None:
            want[k] = stop
    return rows, want


def test_watchdog_batch_and_stream(spark, tmp_path):
    rows, want = _sessions(np.random.default_rng(3), 40)
    df = spark.createDataFrame(rows, "session_id long, i long, mic double, system double")
    assert {r.session_id: r.stop_i for r in sessions.watchdog_stops(df, 2.0).collect()} == want and want
    for k in range(3):
        df.where(f"i between {k * 14} and {k * 14 + 13}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stateful.watchdog_stream(stream, 2.0).writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.session_id: r.stop_i for r in spark.table("stops").collect()} == want


def test_decimate_batch_and_stream(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal(250)
    track = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "session_id long, idx long, x double")
    kernel = np.array(signal.sinc_kernel(3))
    want = np.convolve(x, kernel, "same")[::3]
    got = [r.x for r in signal.fir_decimate(track, 3).orderBy("idx").collect()]
    assert np.allclose(got, want, atol=1e-9) and abs(kernel.sum() - 1) < 1e-12
    cuts, schema = [0, 1, 2, 60, 61, 200, 250], "session_id long, block_idx long, samples array<double>, last boolean"
    for k in range(len(cuts) - 1):
        spark.createDataFrame([(1, k, x[cuts[k] : cuts[k + 1]].tolist(), k == len(cuts) - 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    stateful.decimate_stream(stream, 3).writeStream.format("memory").queryName("dec").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert np.allclose([r.x for r in spark.table("dec").orderBy("idx").collect()], want, atol=1e-9)
    with pytest.raises(ValueError):
        signal.fir_decimate(track, 0)


def test_align_stream(spark, tmp_path):
    schema = "session_id long, block_idx long, channel string, samples array<double>, last boolean"
    polls = [[("mic", [1.0, 2.0, 3.0])], [("system", [9.0]), ("mic", [4.0])], [("system", [8.0, 7.0])]]
    for k, poll in enumerate(polls):
        spark.createDataFrame([(1, k, c, x, k == 2) for c, x in poll], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stateful.align_stream(stream).writeStream.format("memory").queryName("aligned").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.idx, r.mic, r.system) for r in spark.table("aligned").orderBy("idx").collect()] == [(0, 1.0, 9.0), (1, 2.0, 8.0), (2, 3.0, 7.0), (3, 4.0, 0.0)]


def test_wav(spark, tmp_path):
    rng = np.random.default_rng(0)
    left, right = rng.uniform(-1.2, 1.2, 100), rng.uniform(-1, 1, 80)
    (tmp_path / "a.wav").write_bytes(wav.encode_wav([left, right], 16000))
    (tmp_path / "b.wav").write_bytes(wav.encode_wav([left], 48000))
    stereo, mono = wav.read_recordings(spark, str(tmp_path)).orderBy("path").collect()
    assert (stereo.rate, stereo.channels, mono.system) == (16000, 2, None)
    assert np.allclose(stereo.mic, np.clip(left, -1, 1), atol=1e-3) and np.allclose(stereo.system, np.pad(right, (0, 20)), atol=1e-3)


def _speech(rng, n):
    level = np.repeat((rng.random(n // 2000 + 1) < 0.6).astype(float), 2000)[:n]
    return rng.standard_normal(n) * 0.1 * level


def test_echo(spark):
    rng = np.random.default_rng(2)
    far = _speech(rng, 16000 * 8)
    echo = np.convolve(far, [0.2, 0.0, 0.08, 0.0, 0.04])[: len(far)]
    clean = spectral.cancel(echo, far)
    tail = slice(16000 * 4, None)
    assert 10 * np.log10((echo[tail] ** 2).mean() / (clean[tail] ** 2).mean()) > 15
    assert np.array_equal(spectral.cancel(far, np.zeros_like(far)), far.astype(np.float32)) and len(spectral.cancel(np.zeros(0), far)) == 0
    noise = rng.standard_normal(len(far))
    assert np.sqrt((spectral.cancel(noise, far) ** 2).mean()) <= 1.01 * np.sqrt((noise**2).mean())
    delayed = np.concatenate([np.zeros(800), echo])[: len(far)]
    lags, r = spectral.phase_correlation(delayed, far, 16000, 32000, 8000, (300.0, 3400.0))
    assert abs(lags[np.argmax(r)] - 800) < 16
    with pytest.raises(ValueError):
        spectral.segment_delays(None, window_s=0.5)


def test_quantize(spark):
    rows = spark.createDataFrame([(1.5,), (-1.5,), (0.9999,), (float("nan"),)], "x double").select(signal.quantize(F.col("x"))).collect()
    assert [r[0] for r in rows] == [32767, -32767, 32763, 0]


def _streamed(spark, tmp_path, schema, batches, plan, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    plan(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("step", [1.5, 3.0, 0.4, 48000 / 44100])
def test_resample_stream(spark, tmp_path, step):
    x = np.random.default_rng(5).standard_normal(97)
    cuts = [0, 1, 2, 30, 31, 97]
    batches = [[(1, k, x[a:b].tolist())] for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    got = _streamed(spark, tmp_path, "session_id long, block_idx long, samples array<double>", batches, lambda s: stateful.resample_stream(s, step), f"rs{int(step * 10)}").orderBy("idx").collect()
    batch = signal.linear_resample(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "session_id long, idx long, x double"), step).orderBy("idx").collect()
    assert [r.idx for r in got] == [r.idx for r in batch] == list(range(math.ceil(96 / step))) and np.allclose([r.x for r in got], [r.x for r in batch])


def test_frames_stream(spark, tmp_path):
    x = np.arange(20, dtype="<f4").reshape(10, 2)
    raw = x.tobytes()
    batches = [[(1, k, raw[a:b])] for k, (a, b) in enumerate(itertools.pairwise([0, 3, 7, 8, 50, 80]))]
    got = _streamed(spark, tmp_path, "session_id long, packet_idx long, data binary", batches, lambda s: stateful.frames_stream(s, 2), "frames").orderBy("idx").collect()
    assert [(r.idx, r.x) for r in got] == list(enumerate(x.mean(1).tolist()))


def test_recorder(spark, tmp_path):
    rng = np.random.default_rng(8)
    mic, system = rng.uniform(-1, 1, 30), rng.uniform(-1, 1, 24)
    schema = "session_id long, block_idx long, channel string, samples array<double>, last boolean"
    for k in range(3):
        rows = [(4, k, "mic", mic[10 * k : 10 * k + 10].tolist(), False), (4, k, "system", system[8 * k : 8 * k + 8].tolist(), k == 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = stateful.record_stream(stateful.align_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    stateful.recordings(spark, str(tmp_path / "out"), str(tmp_path / "wav"), 16000)
    rate, channels, a, b = wav.decode_wav((tmp_path / "wav" / "4.wav").read_bytes())
    assert (rate, channels) == (16000, 2) and np.allclose(a, mic, atol=2e-3) and np.allclose(b, np.pad(system, (0, 6)), atol=2e-3)


def test_wav_brought_down(spark, tmp_path):
    x = np.sin(np.arange(4800) * 2 * np.pi * 1000 / 48000)
    (tmp_path / "a.wav").write_bytes(wav.encode_wav([x], 48000))
    (r,) = wav.read_recordings(spark, str(tmp_path), 16000).collect()
    track = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(wav.decode_wav(wav.encode_wav([x], 48000))[2])], "session_id long, idx long, x double")
    want = [q.x for q in signal.fir_decimate(track, 3, block=100).orderBy("idx").collect()]
    assert (r.rate, len(r.mic)) == (16000, 1600) and np.allclose(r.mic, want, atol=1e-5) and max(map(abs, r.mic[100:-100])) > 0.95


def test_clean_microphone(spark):
    """A delayed echo is measured, cancelled and put back in place; a session without one stays as it is."""
    rng, rate, lag = np.random.default_rng(11), 2000, 40
    far = rng.standard_normal(rate * 24) * 0.1 * np.repeat(rng.random(48) < 0.6, rate // 2)
    echo = np.concatenate([np.zeros(lag), np.convolve(far, [0.2, 0.0, 0.08])])[: len(far)]
    quiet = rng.standard_normal(len(far)) * 0.01
    rows = [(s, i, float(m), float(f)) for s, mic in ((1, echo), (2, quiet)) for i, (m, f) in enumerate(zip(mic, far, strict=True))]
    both = spark.createDataFrame(rows, "session_id long, idx long, mic double, system double")
    mic, system = (both.select("session_id", "idx", F.col(c).alias("x")) for c in ("mic", "system"))
    clean, report = recordings.clean_microphone(mic, system, rate, 15.0, {"window_s": 0.5, "segment_s": 8.0, "max_lag_s": 0.1, "band": None}, {"block": 64, "reach": 128}, 64)
    found = {r.session_id: r for r in report.collect()}
    assert found[1].cancel and abs(found[1].lag - lag) < 4 and found[1].erle_db > 6 and not found[1].weak and not found[2].cancel and found[2].erle_db is None
    tracks = {s: np.array([r.x for r in clean.where(f"session_id = {s}").orderBy("idx").collect()]) for s in (1, 2)}
    assert np.array_equal(tracks[2], quiet) and len(tracks[1]) == len(echo) and np.array_equal(tracks[1][: found[1].lag], echo[: found[1].lag])
    half = slice(rate * 12, None)
    assert (tracks[1][half] ** 2).mean() < 0.1 * (echo[half] ** 2).mean()


def test_double_talk_and_restart(spark):
    rng = np.random.default_rng(4)
    far, near = _speech(rng, 16000 * 6), _speech(rng, 16000 * 6)
    echo = np.convolve(far, [0.15, 0.0, 0.05])[: len(far)]
    clean = spectral.cancel(near + echo, far)
    assert np.corrcoef(clean, near)[0, 1] > 0.95 and np.abs(clean).max() <= 1.01 * np.abs(near + echo).max()
    whole, parts = (spectral.cancel(near + echo, far, chunk=k) for k in (1024, 3))
    assert np.allclose(whole, parts, atol=1e-6)


def test_summaries_with_prompts(spark, tmp_path):
    asked = lambda body: F.concat(F.lit("<"), F.substring(body, 1, 9), F.lit(">"))
    lines = spark.createDataFrame([(1, k, f"w{k} " * 10) for k in range(6)] + [(1, 9, " \t")], "session_id long, line_no long, line string")
    out = summaries.summarize(lines, 60, complete=asked, prompts={"final": "FINAL {transcript}", "map": "MAP {transcript}", "merge": "MERGE {transcript}"})
    (r,) = out.collect()
    assert r.summary.startswith("<FINAL ") and r.levels >= 1

    def fails(text):
        if "b" in text:
            raise RuntimeError("no model")
        return text.upper()

    noted = spark.createDataFrame([("x", "aa"), ("y", "bb")], "name string, text string").withColumn("summary", summaries.guarded(fails)(F.col("text")))
    summaries.write_notes(noted, "name", str(tmp_path / "notes"))
    assert {r.name: r.value.strip() for r in spark.read.option("wholetext", True).text(str(tmp_path / "notes")).collect()} == {"x": "AA"}
    assert [(r.name, r.summary) for r in noted.orderBy("name").collect()] == [("x", "AA"), ("y", None)]


def test_missing_diarizer_and_zip(spark):
    plain = spark.range(1)
    assert recordings.optional(lambda: 1 / 0, plain, "diarizing") is plain
    rows = spark.createDataFrame([([1, 2], ["a"])], "a array<int>, b array<string>")
    with pytest.raises(Exception, match="unequal size"):
        rows.select(signal.zipped(F.col("a"), F.col("b"))).collect()
