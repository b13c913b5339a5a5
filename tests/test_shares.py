"""Short recordings share tasks."""

import wave

import numpy as np
from pyspark.sql import functions as F

from turnwise.sources import recordings as R
from turnwise.sources import wav


def test_many_short_recordings_share_tasks(spark, tmp_path):
    x = np.arange(21) / 100
    for k in range(700):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode_wav([x + k / 1000, -x], 16000))
    rows = R.read_tracks(spark, str(tmp_path), split=8)
    assert rows.rdd.getNumPartitions() == 3  # 2,100 ranges
    got = rows.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "mic", "system"))).alias("r")).collect()
    assert len(got) == 700 and {r.n for r in got} == {21}
    for r in got[:20]:
        with wave.open(r.path) as w:
            pcm = np.frombuffer(w.readframes(21), "<i2").reshape(-1, 2) / np.float32(32768)
        assert [tuple(v) for v in r.r] == [(i, float(a), float(b)) for i, (a, b) in enumerate(pcm)]


def test_a_share_is_bounded():
    h = R.Header(16000, 2, 80, 10**6)
    shares = R._shares([R.Span("a", h, k, k + 100_000) for k in range(0, 10**6, 100_000)])
    assert [len(s.spans) for s in shares] == [2] * 5 and len(R._shares([R.Span("a", h, 0, R.SPLIT)] * 3)) == 3
