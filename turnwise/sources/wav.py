"""WAV recordings: 16-bit PCM files read through Spark's binaryFile source, and tracks written as WAV bytes."""

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from turnwise.operators.signal import sinc_kernel

_DECODED = StructType([StructField("rate", IntegerType()), StructField("channels", IntegerType()), StructField("mic", ArrayType(FloatType())), StructField("system", ArrayType(FloatType()))])


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray | None]:
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2 or w.getnchannels() > 2:
            raise ValueError("16-bit PCM of one or two channels is expected")
        x = (np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768.0).astype(np.float32)
        return (w.getframerate(), 1, x, None) if w.getnchannels() == 1 else (w.getframerate(), 2, x[0::2], x[1::2])


def encode_wav(channels: list[np.ndarray], rate: int) -> bytes:
    """Shorter channels are padded with zeros; samples are clipped and cut towards zero."""
    n = max((len(c) for c in channels), default=0)
    out = np.zeros((n, len(channels)), "<i2")
    for k, c in enumerate(channels):
        out[: len(c), k] = (np.clip(np.asarray(c, float), -1, 1) * 32767).astype("<i2")
    to = io.BytesIO()
    with wave.open(to, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(out.tobytes())
    return to.getvalue()


def decimated(x: np.ndarray | None, factor: int) -> np.ndarray | None:
    """Every factor-th sample behind a low-pass, zeros beyond the ends."""
    if x is None or factor == 1 or not len(x):
        return x
    kernel = np.array(sinc_kernel(factor))
    half = len(kernel) // 2
    return np.convolve(np.pad(x.astype(float), half), kernel, "valid")[::factor].astype(np.float32)


def read_recordings(spark: SparkSession, path: str, target_rate: int | None = None) -> DataFrame:
    """path, rate, channels, mic, system (null for mono) of every WAV file under path, brought down to target_rate if that is given.

    A rate that isn't a multiple of it is an error."""
    @pandas_udf(_DECODED)
    def decoded(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            rate, channels, mic, system = decode_wav(c)
            to = target_rate or rate
            if rate % to:
                raise ValueError(f"{rate} Hz can't be brought down to {to} Hz")
            rows.append((to, channels, decimated(mic, rate // to), decimated(system, rate // to)))
        return pd.DataFrame(rows, columns=["rate", "channels", "mic", "system"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", decoded("content").alias("r")).select("path", "r.*")


def samples(recordings: DataFrame, key: str, channel: str) -> DataFrame:
    """session_id, idx, x of one channel in long form."""
    return recordings.select(F.col(key).alias("session_id"), F.posexplode(channel).alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


def wav_bytes(*channels: Column, rate: int) -> Column:
    @pandas_udf("binary")
    def encoded(*tracks: pd.Series) -> pd.Series:
        return pd.Series([encode_wav([c for c in row if c is not None], rate) for row in zip(*tracks, strict=True)])

    return encoded(*channels)
