"""Operator 6, mixing sources to target weights.

Words are summed per source; targets share a multiple of the corpus by weight and stop at a highest
repetition rate, the excess going to the other sources by weight until none is above. A source's rate
is target / size: every document of it is emitted floor(rate) times, plus once more if a hash of the
seed and its doc_id, taken as a number in [0, 1), is below the fraction. All sources are one table of
one row each; the join with it is left to adaptive execution, which broadcasts it only after its size
is known and splits a hot source otherwise.

Defined cases: null text has size 0; null source is a source of its own, last in order; a source of
size 0 has target 0 and rate 0; equal doc_ids draw equal copies; an empty table gives an empty result;
a null doc_id draws as the empty text; extra columns, whatever their names, are kept by ``mix`` and
ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.words import count_words, spare

_KEY = "__source_key"


def _key(source: Column) -> Column:
    """Never null, in the order of the source with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, highest: float) -> DataFrame:
    """source key, source_size -> target and rate. One row per source.

    In the order of highest * size / weight, the sources whose limit lies below their share of what is
    left are those that stop at it; running sums find them without a loop.
    """
    by_key = Window.orderBy(_KEY)
    rank = F.row_number().over(by_key) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(highest)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), _KEY).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = caps.withColumn("level", left / weight_left).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # that of the first source that does not stop
    target = F.when(F.col("capped") | final.isNull(), F.col("cap")).otherwise(final * F.col("weight"))
    return level.select(_KEY, "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, highest: float = 2.0, seed: int = 6) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each document; its text is only counted."""
    sized = docs.select("doc_id", _key(F.col("source")).alias(_KEY), count_words(F.col("text")).alias("size"))
    by_source = targets(sized.groupBy(_KEY).agg(F.sum("size").alias("source_size")), weights, share, highest)
    rows = sized.join(by_source, _KEY).withColumn("copies", _copies(F.col("doc_id"), F.col("rate"), seed))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, highest: float = 2.0, seed: int = 6) -> DataFrame:
    """The mixture itself: each document as often as its copies, with its own columns."""
    key, rate, copy = spare(docs.columns, "key", "rate", "copy")
    sized = docs.select(_key(F.col("source")).alias(_KEY), count_words(F.col("text")).alias("size"))
    rates = targets(sized.groupBy(_KEY).agg(F.sum("size").alias("source_size")), weights, share, highest).select(F.col(_KEY).alias(key), F.col("rate").alias(rate))
    rows = docs.withColumn(key, _key(F.col("source"))).join(rates, key)
    again = F.explode(F.array_repeat(F.lit(0), _copies(F.col("doc_id"), F.col(rate), seed))).alias(copy)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], again).drop(copy)


def _copies(doc_id: Column, rate: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("int")
