"""WAV files as rows: a container codec, a chunked scan and sinks.

The scan goes through Spark's binaryFile source, so that any store that Spark reads will do. A
recording becomes rows of bounded chunks; no row holds more than CHUNK samples.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 18
SIGNAL = "stem string, sr int, n long, chunk_no int, start_sample long, samples array<float>"


def header(sr: int, channels: int, bits: int, size: int, float_: bool = False) -> bytes:
    block = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if float_ else 1, channels, sr, sr * block, block, bits) + b"data" + struct.pack("<I", size)


def encode(samples: np.ndarray, sr: int) -> bytes:
    """16-bit WAV of samples in [-1, 1]; a second axis holds channels. Values are truncated toward zero."""
    x = np.asarray(samples, np.float64)
    data = (x * 32767).astype("<i2").tobytes()
    return header(sr, 1 if x.ndim == 1 else x.shape[1], 16, len(data)) + data


def decode(content: bytes, scale_mode: str = "documented") -> tuple[int, np.ndarray]:
    """(sample rate, mono samples). int16 / 32767, int32 / 2147483647, uint8 (x - 128) / 128, float as is; stereo is averaged.

    scale_mode "legacy" keeps integers as they are and divides by 32767 only when the largest exceeds 1.5.
    """
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None:
        raise ValueError("WAV file without a format")
    kind, channels, sr, _, _, bits = form
    dtype = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((kind, bits))
    if dtype is None:
        raise ValueError(f"WAV format {kind} with {bits} bits")
    raw = np.frombuffer(data[: len(data) // (channels * bits // 8) * (channels * bits // 8)], dtype)
    x = raw.astype(np.float64)
    if scale_mode == "legacy":
        x = x.reshape(-1, channels).mean(axis=1)
        return sr, x / 32767 if len(x) and np.abs(x).max() > 1.5 else x
    x = {"u1": lambda: (x - 128) / 128, "<i2": lambda: x / 32767, "<i4": lambda: x / 2147483647}.get(dtype, lambda: x)()
    return sr, x.reshape(-1, channels).mean(axis=1)


def to_signal(files: DataFrame, scale_mode: str = "documented") -> DataFrame:
    """Chunks of the recordings in (stem, content) rows."""

    def run(batches):
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                sr, x = decode(bytes(content), scale_mode)
                starts = range(0, max(len(x), 1), CHUNK)
                yield pd.DataFrame({"stem": stem, "sr": sr, "n": len(x), "chunk_no": range(len(starts)), "start_sample": list(starts), "samples": [x[s : s + CHUNK].astype(np.float32) for s in starts]})

    return files.select("stem", "content").mapInPandas(run, SIGNAL)


def read(spark: SparkSession, paths: str | list[str], scale_mode: str = "documented") -> DataFrame:
    """Chunks of all WAV files at the paths."""
    files = spark.read.format("binaryFile").load(paths)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return to_signal(files.select(stem.alias("stem"), "content"), scale_mode)


def durations(signal: DataFrame) -> DataFrame:
    return signal.groupBy("stem").agg(F.max("sr").alias("sr"), F.max("n").alias("n")).withColumn("seconds", F.col("n") / F.col("sr"))


def tile(signal: DataFrame, start: float, length: float) -> DataFrame:
    """The samples from start for length seconds, chunk by chunk: a filter on chunk ranges and a slice."""
    lo, hi = F.floor(start * F.col("sr")), F.floor((start + length) * F.col("sr"))
    first, last = F.greatest(lo, F.col("start_sample")), F.least(hi, F.col("start_sample") + F.size("samples"))
    cut = F.slice("samples", (first - F.col("start_sample") + 1).cast("int"), (last - first).cast("int"))
    return signal.where(last > first).select("stem", "sr", (F.least(hi, F.col("n")) - lo).cast("long").alias("n"), "chunk_no", (first - lo).alias("start_sample"), cut.alias("samples"))


def converted(signal: DataFrame, sr: int, start: float = 0.0, length: float | None = None) -> DataFrame:
    """A recording's samples from start for length seconds, at another rate, in one chunk; one recording a task."""
    from wavegrid.operators.signal import resample, whole

    def kernel(stem, old, x):
        y = resample(x, max(1, round(len(x) * sr / old))) if len(x) and old != sr else x
        return pd.DataFrame([(stem, sr, len(y), 0, 0, y.astype(np.float32))], columns=["stem", "sr", "n", "chunk_no", "start_sample", "samples"])

    return whole(signal if length is None and not start else tile(signal, start, 1e9 if length is None else length), kernel, SIGNAL)


def assemble(signal: DataFrame, output: str) -> DataFrame:
    """All recordings one after the other in the order of their stems; an error when sample rates differ."""
    from pyspark.sql import Window

    lengths = signal.groupBy("stem").agg(F.max("n").alias("n"), F.max("sr").alias("sr"))
    w = Window.orderBy("stem").rowsBetween(Window.unboundedPreceding, -1)  # one row a recording
    whole = Window.partitionBy()
    mixed = F.min("sr").over(whole) != F.max("sr").over(whole)
    offset = F.when(mixed, F.raise_error(F.lit("recordings of different sample rates")).cast("long")).otherwise(F.coalesce(F.sum("n").over(w), F.lit(0)))
    placed = lengths.select("stem", offset.alias("offset"), F.sum("n").over(whole).alias("total"))
    return signal.join(placed, "stem").select(F.lit(output).alias("stem"), "sr", F.col("total").alias("n"), "chunk_no", (F.col("offset") + F.col("start_sample")).alias("start_sample"), "samples")


def lossless(content: Column, sr: int = 22050) -> Column:
    """8-bit WAV whose samples are a file's bytes, built of binary functions; for content under 2 GB."""
    size = F.length(content)
    little = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))
    head = header(sr, 1, 8, 0)
    return F.concat(F.lit(head[:4]), little(size + 36), F.lit(head[8:40]), little(size), content)


def restored(wav: Column) -> Column:
    """The bytes that ``lossless`` wrapped, and whether they begin like a JPEG."""
    body = F.substring(wav, F.lit(45), F.length(wav))
    return F.struct(body.alias("content"), (F.hex(F.substring(body, 1, 3)) == "FFD8FF").alias("jpeg"))


def stereo(sounds: DataFrame) -> DataFrame:
    """stem, content: 16-bit stereo files of (stem, sr, left, right)."""

    def run(batches):
        for pdf in batches:
            out = [encode(np.stack((np.asarray(a, float), np.asarray(b, float)), axis=1), int(sr)) for sr, a, b in zip(pdf["sr"], pdf["left"], pdf["right"], strict=True)]
            yield pd.DataFrame({"stem": pdf["stem"], "content": out})

    return sounds.select("stem", "sr", "left", "right").mapInPandas(run, "stem string, content binary")


def write(signal: DataFrame, folder: str) -> DataFrame:
    """stem and WAV bytes of whole recordings, for a binary sink; each recording is assembled in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sample")
        x = np.concatenate([np.asarray(s, np.float32) for s in pdf["samples"]])
        return pd.DataFrame({"stem": [pdf["stem"].iloc[0]], "content": [encode(x, int(pdf["sr"].iloc[0]))]})

    out = signal.groupBy("stem").applyInPandas(one, "stem string, content binary")
    out.write.mode("overwrite").parquet(folder)
    return signal.sparkSession.read.parquet(folder)
