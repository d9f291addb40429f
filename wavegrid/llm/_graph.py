"""Connected components by contraction, in DataFrame operations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm._store import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v); all nodes of a component share one root.

    In each round every node takes its smallest neighbour or itself, edges are drawn between what
    their ends took, and loops go. The largest node of each component goes with every round, with
    hashed nodes a fixed share of them does. A hub's edges are pre-aggregated, its joins split by
    adaptive execution. Every round ends in a table in the shared folder, on the way down and on the
    way back up, so no plan holds more than one round whatever the number of rounds.
    """
    left = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        step = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "step")
        taken.append(step)
        ends = left.join(step.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        before, left = left, materialise(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        drop(before)
    if not taken:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    drop(left)
    roots = last = taken.pop()
    roots = roots.withColumnRenamed("to", "root")
    while taken:
        step = taken.pop()
        later = roots.withColumnRenamed("node", "to")
        roots = materialise(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
        drop(step, last)
        last = roots
    return roots
