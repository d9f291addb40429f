"""The stage graph of a recipe: encode, decode, notate, notes_decode, for pictures, as one plan a stage.

A stage is a table of (name, ..., error). A job that fails becomes a row with its error and is left out of
the stages after it; the others go on. Spark runs a stage's jobs in parallel and runs lost ones again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.operators import signal, synth, transcription

#: Each stage and the one whose output it reads.
GRAPH = {"encode": None, "decode": "encode", "notate": "encode", "notes_decode": "notate"}


def jobs_of(names: DataFrame, stages: Sequence[str]) -> DataFrame:
    """name, stage, needs: a job for each name and stage of the graph that is asked for."""
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(GRAPH[s]).cast("string").alias("needs")) for s in GRAPH if s in stages]
    return names.select("name", F.explode(F.array(*rows)).alias("j")).select("name", "j.*")


def ready(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs that are not done and whose input is: name, stage."""
    made = done.select("name", "stage").distinct()
    left = jobs.join(made, ["name", "stage"], "left_anti")
    inputs = made.select(F.col("name"), F.col("stage").alias("needs"), F.lit(True).alias("there"))
    return left.join(inputs, ["name", "needs"], "left").where("needs is null or there").select("name", "stage")


def dry_run(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """stage, done, to_do: counts without running anything."""
    made = done.select("name", "stage").distinct().withColumn("there", F.lit(1))
    return jobs.join(made, ["name", "stage"], "left").groupBy("stage").agg(F.count("there").alias("done"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("to_do"))


def attempt(rows: DataFrame, kernel: Callable[[dict], Mapping[str, object]], schema: str) -> DataFrame:
    """kernel's columns for each row, or nulls and the error's text in the column error."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                made, error = {}, None
                try:
                    made = kernel(row)
                except Exception as e:  # a job's own failure; the run continues
                    error = f"{type(e).__name__}: {e}"
                out.append([*(made.get(n, row.get(n)) for n in names), error])
            yield pd.DataFrame(out, columns=[*names, "error"])

    return rows.mapInPandas(run, schema + ", error string")


def encode(grids: DataFrame, sr: int = 22050, **how) -> DataFrame:
    """name, sr, samples of pictures (name, rows, cols, v)."""

    def kernel(row):
        x = signal.encode_picture(np.asarray(row["v"], float).reshape(row["rows"], row["cols"]), sr, **how)
        return {"sr": sr, "samples": x.astype(np.float32)}

    return attempt(grids, kernel, "name string, sr int, samples array<float>")


def decode(sounds: DataFrame, rows: int, cols: int, **how) -> DataFrame:
    """name, rows, cols, v of sounds."""

    def kernel(row):
        g = signal.decode_sound(np.asarray(row["samples"], float), row["sr"], rows, cols, **how)
        return {"rows": rows, "cols": cols, "v": g.astype(np.float32).ravel()}

    return attempt(sounds, kernel, "name string, rows int, cols int, v array<float>")


def notate(sounds: DataFrame, sr: int, bpm: float = 120, **how) -> DataFrame:
    """name and the notes (start_beat, dur_beats, freq_hz, velocity) of each sound, in order; a sound without notes has an empty list."""
    chunks = sounds.select(F.col("name").alias("stem"), "sr", F.size("samples").cast("long").alias("n"), F.lit(0).alias("chunk_no"), F.lit(0).cast("long").alias("start_sample"), "samples")
    found = transcription.transcribe(chunks, sr, bpm, **how)
    note = F.struct("start_beat", "dur_beats", "freq_hz", "velocity")
    lists = found.groupBy(F.col("stem").alias("name")).agg(F.array_sort(F.collect_list(note)).alias("notes"))  # one sound's notes
    return sounds.select("name").join(lists, "name", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<struct<start_beat:double,dur_beats:double,freq_hz:double,velocity:int>>")))


def perform(scores: DataFrame, sounds: DataFrame, bpm: float = 120, voice: str = "vibes", sr: int = 22050, trim: bool = True) -> DataFrame:
    """name, sr, samples of scores played; one without notes is silence of its sound's length, and trim cuts the ringing end to that length."""

    def kernel(row):
        length = int(round(row["source_n"] / row["source_sr"] * sr))
        score = [(n["start_beat"], n["dur_beats"], n["freq_hz"], n["velocity"]) for n in row["notes"]]
        x = synth.synthesize(score, bpm, sr, voice) if score else np.zeros(length)
        return {"sr": sr, "samples": (x[:length] if trim else x).astype(np.float32)}

    of = sounds.select("name", F.size("samples").alias("source_n"), F.col("sr").alias("source_sr"))
    return attempt(scores.join(of, "name"), kernel, "name string, sr int, samples array<float>")


def render(grids: DataFrame, keep: Callable[[str, DataFrame], DataFrame], sr: int = 22050, rows: int = 200, cols: int = 400, bpm: float = 120, voice: str = "vibes", stages: Sequence[str] = tuple(GRAPH), band: tuple[float, float] = (80.0, 8000.0)) -> dict[str, DataFrame]:
    """Stage -> its table. keep(stage, table) stores a stage where the next can read it, and returns it as stored."""
    lo, hi = band
    out: dict[str, DataFrame] = {}
    fine = lambda t: t.where("error is null")
    out["encode"] = keep("encode", encode(grids, sr, lo=lo, hi=hi))
    if "decode" in stages:
        out["decode"] = keep("decode", decode(fine(out["encode"]), rows, cols, lo=lo, hi=hi))
    if "notate" in stages or "notes_decode" in stages:
        scores = notate(fine(out["encode"]), sr, bpm, lo=lo, hi=hi)
        out["notate"] = keep("notate", scores)
    if "notes_decode" in stages:
        played = perform(out["notate"], fine(out["encode"]), bpm, voice, sr)
        out["notes_decode"] = keep("notes_decode", decode(fine(played), rows, cols, lo=lo, hi=hi))
    return out


def recursion(grids: DataFrame, lens: Callable[[DataFrame], DataFrame], times: int, keep: Callable[[str, DataFrame], DataFrame], rows: int, cols: int, sr: int = 22050, **band) -> DataFrame:
    """step and name, rows, cols, v after each of so many rounds of lens, sound and picture; every round is stored."""
    now, every = grids, None
    for step in range(1, times + 1):
        sounds = encode(lens(now), sr, **band)
        now = keep(f"round-{step}", decode(sounds.where("error is null"), rows, cols, **band)).drop("error")
        this = now.withColumn("step", F.lit(step))
        every = this if every is None else every.unionByName(this)
    return every


def same_encodes(variants: DataFrame, encode_axes: Sequence[str]) -> DataFrame:
    """Adds encode_key, 12 hex digits of the settings that encoding reads, and shared, how many variants use that encode."""
    text = F.to_json(F.struct(*[F.col(f"`{a}`") for a in sorted(encode_axes)]))
    keyed = variants.withColumn("encode_key", F.substring(F.sha2(text, 256), 1, 12))
    return keyed.join(keyed.groupBy("encode_key").agg(F.count(F.lit(1)).alias("shared")), "encode_key")
