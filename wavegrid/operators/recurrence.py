"""Distances between state vectors: recurrence pairs and discords (windows unlike all others)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.operators.ordering import numbered

#: The matrix form broadcasts all vectors; beyond this size it compares pairs of blocks instead.
BROADCAST_BYTES = 64 << 20
#: Rows in a block of the blocked form.
BLOCK = 4096


def pooled(vectors: DataFrame, index: str, vector: str = "embedding", size: int = 1000) -> DataFrame:
    """index, vector: means of runs of vectors in index order, ``size`` of them or one for each vector if there are fewer; a run bears its first index."""
    n = vectors.count()
    rows = vectors.select(F.col(index).alias("index"), F.col(vector).alias("v"))
    if n <= size:
        return rows.select("index", F.transform("v", lambda x: x.cast("double")).alias("vector"))
    pool = F.call_function("div", F.col("place") * size, F.lit(n)).cast("int")
    cells = numbered(rows, "index").select(pool.alias("pool"), "index", F.posexplode("v").alias("k", "x"))
    means = cells.groupBy("pool", "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min("index").alias("index"))
    one = means.groupBy("pool").agg(F.min("index").alias("index"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("x"))  # a vector's cells
    return one.select("index", F.transform("x", lambda s: s["x"]).alias("vector"))


def distance_matrix(vectors: DataFrame, index: str, vector: str = "embedding", size: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(indices in order, distances sqrt(max(2 - 2 a.b, 0)) of all pairs) of vectors pooled to ``size``: a bounded matrix, at the driver."""
    rows = pooled(vectors, index, vector, size).toPandas().sort_values("index")
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    u = _units(np.stack(rows["vector"].to_numpy()).astype(np.float64))
    return rows["index"].to_numpy(), np.sqrt(np.maximum(2 - 2 * u @ u.T, 0))


def pair_distances(vectors: DataFrame, index: str, largest: float | None = None, share: float | None = None, size: int = 1000) -> DataFrame:
    """i < j, d of the pairs of pooled vectors, all or those up to a distance or to a quantile of all distances (rounded to 6 places)."""
    spark = vectors.sparkSession
    names, d = distance_matrix(vectors, index, size=size)
    i, j = np.triu_indices(len(names), 1)
    d = d[i, j]
    if share is not None and len(d):
        keep = np.round(d, 6) <= round(float(np.quantile(d, share)), 6)
        i, j, d = i[keep], j[keep], d[keep]
    if largest is not None:
        i, j, d = i[d < largest], j[d < largest], d[d < largest]
    return spark.createDataFrame(pa.table({"i": pa.array(names[i], pa.int64()), "j": pa.array(names[j], pa.int64()), "d": pa.array(d)}))


def recurrence_levels(vectors: DataFrame, index: str, low: float = 0.02, high: float = 0.98, size: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(indices, brightness of every pair): distances stretched between two quantiles of all pairs, near ones bright."""
    names, d = distance_matrix(vectors, index, size=size)
    if len(names) < 2:
        return names, np.ones_like(d)
    lo, hi = np.quantile(d[np.triu_indices(len(names), 1)], [low, high])
    return names, 1 - np.clip((d - lo) / max(hi - lo, 1e-12), 0, 1)


def discord_scores(vectors: DataFrame, index: str = "vec_id", vector: str = "embedding", exclusion: float = 0.02) -> DataFrame:
    """index, score: distance to the nearest vector further than max(1, floor(n * exclusion)) places away in index order.

    Matrix products block by block in Arrow batches. The vectors are broadcast while they fit BROADCAST_BYTES
    (checked); beyond, every pair of blocks is one group, and the least of its distances is kept. All pairs are
    compared, so the work grows with the square of the vectors; pool them first where a picture is all that is wanted.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(index).alias("index"), F.col(vector).alias("v"))
    n = rows.count()
    band = max(1, int(n * exclusion))
    width = len(rows.first()["v"]) if n else 0
    units = lambda pdf: _units(np.stack(pdf["v"].to_numpy()).astype(np.float64)) if len(pdf) else np.zeros((0, width))

    def least(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), np.inf)
        for k in range(0, len(b), BLOCK):
            d2 = 2 - 2 * a @ b[k : k + BLOCK].T
            d2[np.abs(at_a[:, None] - at_b[None, k : k + BLOCK]) <= band] = np.inf
            out = np.minimum(out, d2.min(axis=1))
        return np.sqrt(np.maximum(out, 0))

    if n * width * 8 <= BROADCAST_BYTES:
        whole = rows.toPandas().sort_values("index")  # its size is known
        shared = spark.sparkContext.broadcast((whole["index"].to_numpy(np.int64), units(whole)))
        step = max(64, -(-n // spark.sparkContext.defaultParallelism))

        def run(batches):
            name, b = shared.value
            at = np.arange(n)
            for pdf in batches:
                for start in pdf["id"]:
                    own = slice(int(start), int(start) + step)
                    yield pd.DataFrame({"index": name[own], "score": least(b[own], at[own], b, at)})

        scores = spark.range(0, n, step).mapInPandas(run, "index long, score double")
    else:
        ordered = numbered(rows, "index")
        blocks = -(-n // BLOCK)
        own = ordered.withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
        left = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def pair(a, b):
            return pd.DataFrame({"index": a["index"], "score": least(units(a), a["place"].to_numpy(), units(b), b["place"].to_numpy())})

        right = left.select(F.col("block").alias("other"), F.col("other").alias("block"), *[F.col(c).alias(c) for c in ("index", "v", "place")])
        partial = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(pair, "index long, score double")
        scores = partial.groupBy("index").agg(F.min("score").alias("score"))
    return scores.where(F.col("score") < float("inf"))


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n < 1e-9, 1.0, n)


def discords(vectors: DataFrame, top: int = 10, **kw) -> DataFrame:
    """The ``top`` vectors with the largest scores; ties go to the lower index."""
    return discord_scores(vectors, **kw).orderBy(F.col("score").desc(), "index").limit(top)
