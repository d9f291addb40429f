"""Scans of frame tables (clip, frame_no, ts, h, w, ch, data): probes, frames at a fixed rate, frames with their real times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GREY = np.array([0.299, 0.587, 0.114])
_FRAMES = "clip string, frame_no long, ts double, h int, w int, ch int, data binary"


def probe(frames: DataFrame) -> DataFrame:
    """clip, width, height, frames, duration (first to last frame)."""
    return frames.groupBy("clip").agg(F.max("w").alias("width"), F.max("h").alias("height"), F.count(F.lit(1)).alias("frames"), (F.max("ts") - F.min("ts")).alias("duration"))


def at_rate(frames: DataFrame, fps: float) -> DataFrame:
    """Frames at an even rate: tick k of a clip shows its last frame at or before (k + 1/2) / fps; a gap repeats the frame before it. frame_no becomes k."""
    tick = F.floor((F.col("ts") - F.min("ts").over(Window.partitionBy("clip"))) * fps + 0.5)
    order = Window.partitionBy("clip", "__tick").orderBy(F.desc("ts"), F.desc("frame_no"))
    kept = frames.withColumn("__tick", tick).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    following = F.lead("__tick").over(Window.partitionBy("clip").orderBy("__tick"))
    kept = kept.withColumn("__last", F.coalesce(following - 1, F.col("__tick")))
    return kept.withColumn("frame_no", F.explode(F.sequence("__tick", "__last"))).withColumn("ts", F.col("frame_no") / F.lit(float(fps))).drop("__tick", "__n", "__last")


def within(frames: DataFrame, start: float = 0.0, duration: float | None = None) -> DataFrame:
    """Frames of a time range; real times stay."""
    kept = frames.where(F.col("ts") >= start)
    return kept if duration is None else kept.where(F.col("ts") < start + duration)


def _weights(have: int, want: int) -> np.ndarray:
    """want x have: share of each old place in each new one, by the area that they have in common."""
    edges = np.linspace(0, have, want + 1)
    old = np.arange(have)
    common = np.minimum(edges[1:, None], old + 1) - np.maximum(edges[:-1, None], old)
    return np.clip(common, 0, None) * want / have


def sized(frames: DataFrame, width: int, height: int | None = None, box: tuple[int, int, int, int] | None = None, colour: bool = False) -> DataFrame:
    """Frames cropped to a box (x, y, w, h), scaled by area and, unless colour is asked for, turned grey; without a height the shape is kept and the height even."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                f = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, r.ch).astype(float)
                if box:
                    x, y, w, h = box
                    f = f[y : y + h, x : x + w]
                f = f if colour and f.shape[2] == 3 else (f @ GREY if f.shape[2] == 3 else f[..., 0])[..., None]
                shape = f.shape[:2]
                if shape not in sides:
                    sides[shape] = _weights(shape[0], height or max(2, round(shape[0] * width / shape[1] / 2) * 2)), _weights(shape[1], width)
                down, across = sides[shape]
                small = np.rint(np.einsum("rh,hwc,vw->rvc", down, f, across)).clip(0, 255).astype(np.uint8)
                out.append((r.clip, r.frame_no, r.ts, *small.shape, small.tobytes()))
            yield pd.DataFrame(out, columns=["clip", "frame_no", "ts", "h", "w", "ch", "data"])

    return frames.select("clip", F.col("frame_no").cast("long").alias("frame_no"), "ts", "h", "w", "ch", "data").mapInPandas(run, _FRAMES)


def two_at_least(frames: DataFrame) -> DataFrame:
    """The frames, or an error when a clip has fewer than two, in which nothing can move."""
    n = F.count(F.lit(1)).over(Window.partitionBy("clip"))
    bad = F.raise_error(F.concat(F.lit("fewer than two frames in "), "clip")).cast("boolean")
    return frames.withColumn("__n", n).where(F.when(F.col("__n") < 2, bad).otherwise(True)).drop("__n")
