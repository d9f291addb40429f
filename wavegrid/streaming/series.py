"""Structured Streaming counterparts of the series operators: steps, bursts, changes and block spectra.

Inputs have an event-time column; a wall-clock timestamp without zone is cast, because watermarks need
one. State is one small row per key: an open window's sums, the last sample, or the tail of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def events(spark: SparkSession, folder: str, schema, late: str = "1 hour", files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with a watermark on ts."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def step_means(stream: DataFrame, key: str, step: str, value: str = "value") -> DataFrame:
    """Mean, largest and number of the values of each key in each step of event time."""
    g = stream.groupBy(F.window("ts", step).alias("w"), key).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count(F.lit(1)).alias("samples"))
    return g.select(key, F.col("w.start").alias("start"), "mean", "most", "samples")


def bursts(stream: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of each key that a longer gap than ``gap`` ends."""
    g = stream.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("samples"))
    return g.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "samples")


def changes(stream: DataFrame, key: str, value: str = "value", key_type: str = "long") -> DataFrame:
    """|change| from the key's sample before, in order of event time within each trigger; the last sample is carried.

    Samples that arrive late by more than a trigger are compared with the sample seen last.
    """

    def run(k, batches: Iterator[pd.DataFrame], state):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        values = rows[value].to_numpy(float)
        before = np.concatenate(([np.nan if last is None else last], values[:-1]))
        state.update((float(values[-1]),))
        out = pd.DataFrame({key: k[0], "event_id": rows["event_id"].to_numpy(), "change": np.abs(values - before)})
        yield out[~np.isnan(before)]

    return stream.select(key, "event_id", "ts", value).groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, event_id long, change double", "last double", "append", "NoTimeout")


def block_powers(stream: DataFrame, size: int = 4096) -> DataFrame:
    """stem, blocks, power: power of the whole blocks that have arrived of each recording; the remainder is carried.

    Chunks of a recording must arrive in order, as a reader of one file gives them.
    """
    from wavegrid.operators.signal import hann

    def run(k, batches: Iterator[pd.DataFrame], state):
        rows = pd.concat(list(batches)).sort_values("start_sample")
        tail, done = (np.array(state.get[0]), state.get[1]) if state.exists else (np.empty(0), 0)
        x = np.concatenate([tail, *[np.asarray(s, float) for s in rows["samples"]]])
        n = len(x) // size
        power = (np.abs(np.fft.rfft(x[: n * size].reshape(n, size) * hann(size, False), axis=1)) ** 2).sum()
        state.update((x[n * size :].tolist(), done + n))
        yield pd.DataFrame({"stem": [k[0]], "blocks": [done + n], "power": [float(power)]})

    return stream.select("stem", "start_sample", "samples").groupBy("stem").applyInPandasWithState(run, "stem string, blocks long, power double", "tail array<double>, done long", "update", "NoTimeout")


def idempotent_sink(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, then stop; a batch that is run again after a failure overwrites its own folder and nothing else."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
