"""Normalisation of pictures and spectra in long form: one row per cell, many pictures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.numbers import clip01
from wavegrid.operators.ordering import quantiles


def auto_prep(cells: DataFrame, key: str, value: str, gamma: float = 1.3) -> DataFrame:
    """Clip to percentiles 1 and 99, stretch, invert pictures whose median is above 0.5, apply gamma. Adds v and inverted.

    Percentiles are exact and aggregated per picture; the small result joins back to the cells.
    """
    p = cells.groupBy(key).agg(F.percentile(value, [0.01, 0.99]).alias("__p"), F.percentile(value, 0.5).alias("__m"))
    lo, hi = F.element_at("__p", 1), F.element_at("__p", 2)
    stretch = lambda x: F.when(hi > lo, clip01((x - lo) / (hi - lo))).otherwise(clip01(x))
    p = p.withColumn("inverted", stretch(F.col("__m")) > 0.5)
    v = cells.join(p, key).withColumn("v", stretch(F.col(value)))
    return v.withColumn("v", F.pow(F.when(F.col("inverted"), 1 - F.col("v")).otherwise(F.col("v")), F.lit(gamma))).drop("__p", "__m")


def log_compressed(cells: DataFrame, key: str, value: str, gain: float = 50.0) -> DataFrame:
    """ln(1 + gain * v), stretched to [0, 1] per picture, and its 8-bit level (truncated)."""
    w = Window.partitionBy(key)
    x = cells.withColumn("__x", F.log1p(gain * F.col(value)))
    span = F.max("__x").over(w) - F.min("__x").over(w)
    x = x.withColumn("v", F.when(span > 0, (F.col("__x") - F.min("__x").over(w)) / span).otherwise(0.0))
    return x.withColumn("level", F.floor(F.col("v") * 255).cast("int")).drop("__x")


def scaled_to_unit(cells: DataFrame, key: str, value: str, percent: float = 99.5) -> DataFrame:
    """v / percentile of the positive values of its series, at most 1."""
    p = cells.where(F.col(value) > 0).groupBy(key).agg(F.percentile(value, percent / 100).alias("__p"))
    return cells.join(p, key, "left").withColumn("v", F.least(F.col(value) / F.greatest(F.coalesce("__p", F.lit(0.0)), F.lit(1e-6)), F.lit(1.0))).drop("__p")


def robust_scores(cells: DataFrame, row: str, value: str, limit: float = 6.0, hot: bool = False) -> DataFrame:
    """(v - median) / (1.4826 * MAD) of its row, clipped to +-limit.

    A row's distinct values, counted before the shuffle, meet in one task. Where they do not fit there, ``hot`` finds the
    same medians range by range, in more stages.
    """
    plain = lambda df, v, name: df.groupBy(row).agg(F.array(F.percentile(v, 0.5)).alias(name))
    middle = (lambda df, v, name: quantiles(df, row, v, [0.5], name)) if hot else plain
    off = cells.join(middle(cells, value, "__median"), row).withColumn("__off", F.abs(F.col(value) - F.col("__median")[0]))
    z = (F.col(value) - F.col("__median")[0]) / F.greatest(1.4826 * F.col("__mad")[0], F.lit(1e-9))
    scored = off.join(middle(off, "__off", "__mad"), row).withColumn("score", F.least(F.greatest(z, F.lit(-limit)), F.lit(limit)))
    return scored.drop("__off", "__median", "__mad")


def palette_table(spark, stops: list[str]) -> DataFrame:
    """level 0..255 -> r, g, b by linear interpolation of evenly spaced stops."""
    rgb = [[int(s[i : i + 2], 16) for i in (1, 3, 5)] for s in stops]
    part = F.col("id") * (len(stops) - 1) / F.lit(255.0)
    at = F.least(F.floor(part), F.lit(len(stops) - 2)).cast("int")
    channel = lambda c: F.array(*[F.lit(float(x[c])) for x in rgb])
    lerp = lambda c: F.element_at(channel(c), at + 1) + (part - at) * (F.element_at(channel(c), at + 2) - F.element_at(channel(c), at + 1))
    return spark.range(256).select(F.col("id").cast("int").alias("level"), *[F.bround(lerp(c)).cast("int").alias(n) for c, n in enumerate("rgb")])


def palette_levels(cells: DataFrame, key: str, value: str) -> DataFrame:
    """8-bit level after a stretch of percentiles 1 and 99.5 of the picture."""
    p = cells.groupBy(key).agg(F.percentile(value, [0.01, 0.995]).alias("__p"))
    lo, hi = F.element_at("__p", 1), F.element_at("__p", 2)
    return cells.join(p, key).withColumn("level", F.floor(clip01((F.col(value) - lo) / F.greatest(hi - lo, F.lit(1e-9))) * 255).cast("int")).drop("__p")
