"""Streams must end where the batch operators do."""

import numpy as np
from pyspark.sql import functions as F

from wavegrid.operators import series as batch
from wavegrid.streaming import series


def feed(spark, small, tmp_path, parts=3):
    e = spark.read.parquet(f"{small}/events.parquet")
    for k in range(parts):  # one file after the other, in the order of time
        e.where((F.dayofmonth("ts") - 1) * parts / 31 - k >= 0).where((F.dayofmonth("ts") - 1) * parts / 31 - k < 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, series.events(spark, str(tmp_path / "in"), e.schema, "60 days", 1)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_step_means(spark, small, tmp_path):
    e, s = feed(spark, small, tmp_path)
    got = run(series.step_means(s, "event_type", "1 day"), "steps", "complete", tmp_path)
    want = e.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    assert sorted((r.event_type, r.start.date(), round(r["mean"], 6), r.samples) for r in got.collect()) == sorted((r.event_type, r.d, round(r.m, 6), r.n) for r in want.collect())


def test_bursts(spark, small, tmp_path):
    e, s = feed(spark, small, tmp_path)
    got = run(series.bursts(s, "user_id", "1800 seconds"), "bursts", "complete", tmp_path)
    want = batch.bursts(e.withColumn("t", batch.seconds(F.col("ts"))), "user_id", 1800.0)
    assert sorted((r.user_id, r.samples) for r in got.collect()) == sorted((r.user_id, r.samples) for r in want.collect())


def test_changes(spark, small, tmp_path):
    e, s = feed(spark, small, tmp_path)
    out = series.changes(s, "user_id")
    q = series.idempotent_sink(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.event_id: round(r.change, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: round(r.delta, 6) for r in batch.deltas(e, "user_id", ["ts", "event_id"]).collect()}
    assert got.keys() == want.keys() and got == want


def test_block_powers(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal(1000)
    for k in range(4):
        spark.createDataFrame([("s", k * 250, x[k * 250 : (k + 1) * 250].tolist())], "stem string, start_sample long, samples array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("stem string, start_sample long, samples array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(series.block_powers(raw, 64), "blocks", "update", tmp_path)
    from wavegrid.operators.signal import hann

    want = (np.abs(np.fft.rfft(x[:960].reshape(15, 64) * hann(64, False), axis=1)) ** 2).sum()
    rows = got.collect()
    assert max(r.blocks for r in rows) == 15 and abs(sum(r.power for r in rows) - want) < 1e-6 * want
