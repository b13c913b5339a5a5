"""Prefix scans by cells, peaks from a bounded set and the bound on text ratios, against plain Python."""

import difflib
import itertools
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import intervals, scan, segments, sessions, signal
from turnwise.plans import catalog


@pytest.mark.parametrize("span", [1, 3, 50, 10**6])
def test_numbers(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, float("nan"), -1e9, 3.0, 3.0, rng.random() * 100]), k) for k in range(400)]
    rows += [(3, float("inf"), 0), (3, 1.0, 1), (3, float("-inf"), 2), (4, None, 0)]
    df = spark.createDataFrame(rows, "s long, t double, k long")
    got = scan.numbered(df, ["s"], ["t", "k"], "n", span=span).collect()
    rank = lambda t: (0, 0) if t is None else (2, 0) if t != t else (1, t)
    for s in {r[0] for r in rows}:
        own = sorted((r for r in got if r.s == s), key=lambda r: r.n)
        want = sorted((r for r in rows if r[0] == s), key=lambda r: (rank(r[1]), r[2]))
        assert [r.n for r in own] == list(range(1, len(want) + 1)) and [r.k for r in own] == [r[2] for r in want]
    assert scan.numbered(df.limit(0), ["s"], ["t", "k"], "n").collect() == []


def test_a_long_session_is_cut(spark):
    df = spark.range(100_000).select(F.lit(1).alias("s"), (F.col("id") * 0.5).alias("t"))
    sizes = [r["count"] for r in scan.in_cells(df, ["s"], "t", 1000).groupBy("_cell").count().collect()]
    assert len(sizes) == 100 and max(sizes) <= 1001


@pytest.mark.parametrize("span", [1, 4, 10**6])
def test_islands(spark, span):
    rng = random.Random(span)
    rows = [(s, float(t), rng.choice([None, 0.0, 1.0, 1.0, 9.0, 9.5])) for s in (1, 2) for t in range(60)] + [(3, 1.0, 4.0)]
    got = sessions.islands(spark.createDataFrame(rows, "session_id long, t double, d double"), 2.0, span).orderBy("session_id", "t").collect()
    for s, own in itertools.groupby(got, lambda r: r.session_id):
        own, island, last = list(own), 0, None
        for k, r in enumerate(own):
            island += k > 0 and r.d is not None and last is not None and abs(r.d - last) > 2
            assert r.island == island, (s, k)
            last = r.d


@pytest.mark.parametrize("span", [1, 5, 10**6])
def test_silence(spark, span):
    rng = np.random.default_rng(span % 97)
    rows = [(s, i, float(rng.choice([1e-5, 0.5], p=[0.9, 0.1])), None) for s in range(4) for i in range(80)]
    df = spark.createDataFrame(rows, "session_id long, i long, mic double, system double")
    got = sessions.silence_runs(df, span=span).orderBy("session_id", "i").collect()
    limits = {r.session_id: r.thr for r in sessions.watchdog_thresholds(df).collect()}
    last = {}
    for r in got:
        mic = rows[r.session_id * 80 + r.i][2]
        assert r.act == (mic > limits[r.session_id])
        last[r.session_id] = r.i if r.act else last.get(r.session_id)
        assert r.silence == (0.0 if last[r.session_id] is None else (r.i - last[r.session_id]) * 0.25)
    assert len(got) == 4 * 68


def test_interleave_ties(spark):
    rows = [(1, 2.0, "system", 0), (1, 2.0, "mic", 5), (1, 2.0, "mic", 1), (1, 0.0, "system", 9)]
    got = segments.interleave(spark.createDataFrame(rows, "session_id long, start double, channel string, seq long")).orderBy("pos").collect()
    assert [(r.pos, r.seq) for r in got] == [(1, 9), (2, 1), (3, 5), (4, 0)]


@pytest.mark.parametrize("apart", [1, 3, 20])
def test_peaks(spark, apart):
    rng = random.Random(apart)
    rows = [(s, rng.randint(-60, 60), float(rng.randint(0, 40))) for s in range(5) for _ in range(150)]
    got = sessions.top_peaks(spark.createDataFrame(rows, "s long, p long, v double"), "s", "p", "v", apart).collect()
    for s in range(5):
        best = {}
        for _, p, v in (r for r in rows if r[0] == s):
            best[p] = max(best.get(p, -1.0), v)
        taken = []
        for p, v in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if len(taken) < 6 and all(abs(p - q) >= apart for q, _ in taken):
                taken.append((p, v))
        assert [(r.p, r.v) for r in sorted((r for r in got if r.s == s), key=lambda r: r["rank"])] == taken


def _texts(rng, n):
    words = ["alpha", "beta", "gamma", "été", "底", "a", "😀x", "the", ""]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]
    return base + [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in base] + [t[::-1] for t in base]


def test_bounds_on_ratios(spark):
    """No pair's ratio exceeds its bounds, long texts with popular characters included."""
    rng = random.Random(1)
    texts = _texts(rng, 12)
    pairs = spark.createDataFrame([(a, b) for a in texts for b in rng.sample(texts, 12)], "a string, b string")
    bound = T.ratio_bound(F.col("a"), F.col("b"), T.characters(F.col("a")), T.characters(F.col("b")))
    for r in pairs.select("a", "b", bound.alias("x"), T.length_bound(F.col("a"), F.col("b")).alias("y"), T.text_ratio("a", "b").alias("r")).collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() <= min(r.x, r.y) + 1e-12


def test_bound_leaves_results_alone(spark):
    """The same rows with and without the bound, against every overlapping pair, texts over 200 characters among them."""
    rng, rows = random.Random(2), []
    for k, t in enumerate(_texts(rng, 20)):
        rows.append((k % 3, k, rng.choice(["mic", "system"]), float(k % 7), float(k % 7 + rng.randint(0, 9)), t * rng.choice([1, 1, 4])))
    df = spark.createDataFrame(rows, "session_id long, seq long, channel string, start double, end double, text string")
    test = lambda a, b: T.text_ratio(a, b) >= 0.6
    plain, bounded = (sorted(r.seq for r in intervals.drop_bleed(df, test, least=x).collect()) for x in (None, 0.6))
    normal = {r.seq: r.n for r in df.select("seq", T.normalize(F.col("text")).alias("n")).collect()}
    bleed = {m[1] for m in rows for s in rows if m[2] == "mic" and s[2] == "system" and m[0] == s[0] and m[3] < s[4] and s[3] < m[4] and normal[m[1]] and difflib.SequenceMatcher(None, normal[m[1]], normal[s[1]]).ratio() >= 0.6}
    assert plain == bounded == sorted({r[1] for r in rows} - bleed) and bleed and max(map(len, normal.values())) > 200
    rates = [sorted(map(tuple, intervals.duplication_rate(df, lambda a, b: T.text_ratio(a, b) > 0.6, least=x).collect())) for x in (None, 0.6)]
    assert rates[0] == rates[1]


def test_bound_spares_most_pairs(spark):
    """Overlapping pairs of the table that are left for the ratio itself."""
    s = catalog._doubled(spark, SF).withColumn("norm", T.normalize(F.col("text")))
    mic, system = (s.where(F.col("channel") == c).select("session_id", "seq", "start", "end", "norm", T.characters(F.col("norm")).alias("c")) for c in ("mic", "system"))
    pairs = intervals.interval_join(mic, system.drop("seq"), "session_id", 60.0).where("start < r_end and r_start < end")
    a, b = F.col("norm"), F.col("r_norm")
    n, by_length, by_characters, alike = pairs.agg(F.count("*"), F.count_if(T.length_bound(a, b) >= 0.6), F.count_if(T.ratio_bound(a, b, F.col("c"), F.col("r_c")) >= 0.6), F.count_if(T.ratio_bound(a, b, F.col("c"), F.col("r_c")) >= 0.9)).first()
    assert by_length < n and by_characters <= by_length and alike >= 1
    print(f"pairs {n}, by length {by_length}, by characters {by_characters}")


def test_json_fields(spark):
    df = spark.createDataFrame([('{"rate": 48000, "channels": 2, "more": [1]}',)], "line string")
    assert tuple(df.select(T.json_fields(F.col("line"), "rate int, channels int").alias("h")).first().h) == (48000, 2)
    for line, why in (("{", "FAILFAST|MALFORMED|Malformed"), ('{"rate": 1}', "no channels"), ('{"rate": "x", "channels": 1}', "FAILFAST|MALFORMED|Malformed"), (None, "no rate")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(line,)], "line string").select(T.json_fields(F.col("line"), "rate int, channels int").alias("h")).collect()


@pytest.mark.parametrize(("n", "factor", "block"), [(1, 3, 4), (13, 3, 4096), (250, 2, 7), (1000, 3, 1), (97, 5, 3)])
def test_decimation_in_blocks(spark, n, factor, block):
    x = np.random.default_rng(n).standard_normal(n)
    rows = [(s, i, float(v)) for s in (1, 2, 7) for i, v in enumerate(x)]
    random.Random(n).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = signal.fir_decimate(spark.createDataFrame(rows, "session_id long, idx long, x double"), factor, block=block).orderBy("session_id", "idx").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kernel = np.array(signal.sinc_kernel(factor))
    half = len(kernel) // 2
    want = np.convolve(np.pad(x, half), kernel, "valid")[::factor]
    assert [r.idx for r in got] == list(range(len(want))) * 3 and np.allclose([r.x for r in got], np.tile(want, 3), atol=1e-9)
