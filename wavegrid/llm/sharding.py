"""Operator 2, sharding: a Feistel permutation with cycle walking over global row numbers.

Built of SQL functions only. Rows get gapless global numbers in a fixed order; the permutation moves
number r to place p(r) in [0, n), and shard = p mod shards, slot = p div shards. Shard counts differ
by one at most, the order within a shard is a pseudo-random shuffle, and anyone who knows n, the seed
and a row's number can compute its shard and slot (``locate``).

Defined cases: null text has size 1 and the CRC of the empty text; equal (doc_id, text) rows are
interchangeable and get consecutive numbers; null doc_id comes first within its bucket; fewer rows
than shards leave shards empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of cycle walking. The domain has fewer than sqrt(n) + 1 places beyond n, so a walk that needs
#: more steps is impossible for n <= 4096 and has probability below n ** -32 otherwise; it raises an error.
WALK = 66
#: Rows are numbered bucket by bucket; the table of bucket offsets has this many rows at most.
BUCKETS = 4096
#: Copies of one row that one task expands.
PIECE = 1 << 16


def domain(n: int) -> tuple[int, int]:
    """Sides a * b >= n of the permutation's domain, as tight as two near-equal sides allow."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(row: Column, n: int, seed: int) -> Column:
    """Place of a row number in [0, n)."""
    a, b = domain(n)

    def step(s: Column, i: Column) -> Column:
        into_l = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a).cast("long")), F.lit(a).cast("long"))
        into_r = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b).cast("long")), F.lit(b).cast("long"))
        even = i % 2 == 0
        return F.struct(F.when(even, into_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(into_r).alias("r"))

    def once(x: Column) -> Column:
        side = F.lit(a).cast("long")
        start = F.struct((x % side).alias("l"), F.call_function("div", x, side).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["r"] * side + s["l"])

    size = F.lit(n).cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(row), lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.when(walk < size, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def _hash(*values: int, widths: str) -> int:
    """Spark's xxhash64 of integers; widths: q for a long, i for an int."""
    import xxhash

    h = 42
    for v, w in zip(values, widths, strict=True):
        h = xxhash.xxh64_intdigest(struct.pack("<" + w, v), h)
    return h - (1 << 64) if h >> 63 else h


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a global row number, computed without Spark."""
    a, b = domain(n)
    x = row
    while True:
        left, right = x % a, x // a
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _hash(right, i, seed, widths="qii") % a) % a
            else:
                right = (right + _hash(left, i, seed, widths="qii") % b) % b
        x = right * a + left
        if x < n:
            return x % shards, x // shards


def number_rows(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Columns and a gapless row_number from 0, without a window over all rows.

    Equal keys are counted before the shuffle, so a key that holds many rows is one row until it is
    expanded. Buckets are numbered one after the other; their offsets are one bounded table.
    """
    counted = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int"))
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = sizes.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    first = counted.withColumn("first", F.sum("copies").over(within) - F.col("copies"))
    ranges = first.join(F.broadcast(offsets), "bucket").withColumn("first", F.col("first") + F.col("offset"))
    # a key of many copies is dealt out in pieces before it is expanded
    pieces = ranges.withColumn("piece", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1, F.lit(PIECE).cast("long")))).repartition("piece")
    last = F.least(F.col("piece") + PIECE, F.col("first") + F.col("copies")) - 1
    return pieces.select(*columns, F.explode(F.sequence("piece", last)).alias("row_number"))


def shard(documents: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of each document."""
    text = F.coalesce("text", F.lit(""))
    keys = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = keys.count()
    if n == 0:
        return keys.select("*", F.lit(0).cast("long").alias("row_number"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    rows = number_rows(keys, ["doc_id", "size", "text_crc32"]).withColumn("place", permute(F.col("row_number"), n, seed))
    width = F.lit(shards).cast("long")
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("place") % width).cast("int").alias("shard"), F.call_function("div", F.col("place"), width).alias("slot"),
    )
