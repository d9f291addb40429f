"""Scans of picture files of any format that Spark's image source decodes, as the grids that encoding reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.operators.signal import resize

# Weights of red, green and blue in 8-bit luma, in thousandths.
LUMA = np.array([299, 587, 114])


def luma(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """8-bit luma of blue-green-red rows, as the image source gives them; grey stays, alpha is dropped."""
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return p[..., 0]
    return ((p[..., 2::-1].astype(np.int64) @ LUMA + 500) // 1000).astype(np.uint8)


def grids(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """stem, rows, cols, v in [0, 1] of all pictures under a path, scaled by Lanczos to rows x cols, the lowest row first; files that are no pictures are left out."""
    files = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")
    stem = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                small = np.clip(np.rint(resize(luma(bytes(r.data), r.height, r.width, r.nChannels).astype(float), rows, cols)), 0, 255)
                out.append((r.stem, rows, cols, (small[::-1] / 255).astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["stem", "rows", "cols", "v"])

    wanted = files.select(stem.alias("stem"), "height", "width", "nChannels", "data")
    return wanted.mapInPandas(run, "stem string, rows int, cols int, v array<float>")
