"""Gapless places in a total order, and exact quantiles, without a window or an aggregate over all rows of a key."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges that are numbered one after the other; their bounds and offsets are this many rows.
RANGES = 256


def range_of(x: Column, bounds: Sequence[float | int]) -> Column:
    """How many of ascending bounds are at most x, by two steps over about the root of their number."""
    if not bounds:
        return F.lit(0)
    side = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    # a sum, as the optimiser draws wrong conclusions from size(filter(...)) on the other side of a join
    up_to = lambda values: F.aggregate(values, F.lit(0), lambda s, b: s + F.when(b <= x, 1).otherwise(0))
    part = up_to(F.array(*[F.lit(p[0]) for p in parts]))
    inner = F.element_at(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), F.greatest(part, F.lit(1)))
    return F.when(part == 0, 0).otherwise((part - 1) * side + up_to(inner))


def _as_number(df: DataFrame, order: str) -> Column:
    """A number that never falls along the order: the column, or the seven bytes of a string after what all strings begin with."""
    if not isinstance(df.schema[order].dataType, StringType):
        return F.col(order)
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    shared = len(os.path.commonprefix([(ends["lo"] or "").encode(), (ends["hi"] or "").encode()]))
    return F.conv(F.rpad(F.hex(F.substring(F.col(order).cast("binary"), shared + 1, 7)), 14, "0"), 16, 10).cast("long")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds place, from 0, in the order of a numeric or string column; equal values take places in any order."""
    number = _as_number(df, order)
    cuts = df.select(F.percentile_approx(number, [i / RANGES for i in range(1, RANGES)], 10000).alias("c")).first()["c"] or []
    parted = df.withColumn("__part", range_of(number, sorted({c for c in cuts if c is not None})))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parted.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn("place", F.col("__local") + F.col("__offset")).drop("__part", "__local", "__offset")


def quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float], name: str) -> DataFrame:
    """key and an array, called ``name``, of exact quantiles (linear between the two nearest values) of each key's values.

    Equal values are counted first. A key's counts are summed by ranges of values, whose bounds are an
    approximate sketch; only the ranges that hold a wanted rank are then ordered, each in a task of its own.
    So one key may hold most of the rows. Null values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__v"))
    counted = rows.groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("__n"))
    cuts = rows.groupBy("__key").agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 2000).alias("__cuts"), F.count(F.lit(1)).alias("__all"))
    # a sketch's bounds ascend, so the last one at most x tells the range
    part = F.aggregate("__cuts", F.lit(0), lambda s, c: s + F.when(c <= F.col("__v"), 1).otherwise(0))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ranged = counted.join(cuts.withColumnRenamed("__key", "__k"), same("__key", "__k")).select("__key", "__v", "__n", "__all", part.alias("__part"))
    sums = ranged.groupBy("__key", "__part", "__all").agg(F.sum("__n").alias("__m"))
    order = Window.partitionBy("__key").orderBy("__part")  # RANGES rows a key
    sums = sums.withColumn("__before", F.sum("__m").over(order) - F.col("__m"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__all") - 1)).alias("at")) for i, q in enumerate(shares)])
    wanted = sums.withColumn("__want", F.filter(at, lambda w: (F.ceil(w["at"]) >= F.col("__before")) & (F.floor(w["at"]) < F.col("__before") + F.col("__m")))).where(F.size("__want") > 0)
    wanted = wanted.select(F.col("__key").alias("__k"), F.col("__part").alias("__p"), "__before", "__want")
    found = ranged.join(wanted, same("__key", "__k") & (F.col("__part") == F.col("__p")))
    upto = Window.partitionBy("__key", "__part").orderBy("__v")
    found = found.withColumn("__first", F.col("__before") + F.sum("__n").over(upto) - F.col("__n")).withColumn("__w", F.explode("__want"))
    low, high = F.floor("__w.at"), F.ceil("__w.at")
    holds = lambda r: (F.col("__first") <= r) & (r < F.col("__first") + F.col("__n"))
    ends = found.groupBy("__key", F.col("__w.i").alias("__i"), F.col("__w.at").alias("__at")).agg(
        F.max(F.when(holds(low), F.col("__v"))).alias("__lo"), F.max(F.when(holds(high), F.col("__v"))).alias("__hi")
    )
    value_at = F.col("__lo") + (F.col("__at") - F.floor("__at")) * (F.col("__hi") - F.col("__lo"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", value_at.alias("v")))), lambda s: s["v"])  # len(shares) values
    return ends.groupBy("__key").agg(listed.alias(name)).withColumnRenamed("__key", key)
