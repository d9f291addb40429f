"""Operators on uneven time series: one row per sample with a key, a time in seconds and a value.

Every window is partitioned by the series key and ordered by time with a tie-break, so that results do
not depend on the order of arrival; series are independent and spread over the cluster by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Epoch seconds of a wall-clock time read as UTC, whatever the session's time zone."""
    return micros(ts) / 1e6


def micros(ts: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def by(key: str | list[str], *order: str):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def deltas(df: DataFrame, key: str, order: list[str], value: str = "value", floor: float = 0.0) -> DataFrame:
    """Adds delta: the absolute change from the sample before, less a floor; the first of a series has none and goes."""
    d = F.abs(F.col(value) - F.lag(value).over(by(key, *order)))
    return df.withColumn("delta", F.when(d.isNotNull(), F.greatest(d - floor, F.lit(0.0)))).where("delta is not null")


def skips(df: DataFrame, key: str, t: str = "t", tie: str = "event_id", least: float = 0.5, times: float = 4.0) -> DataFrame:
    """Gaps longer than max(least, times * median gap) of their series: key, time before, gap, median."""
    gaps = df.withColumn("gap", F.col(t) - F.lag(t).over(by(key, t, tie))).where("gap is not null")
    with_median = gaps.withColumn("median_gap", F.percentile("gap", 0.5).over(Window.partitionBy(key)))
    return with_median.where(F.col("gap") > F.greatest(F.lit(least), times * F.col("median_gap")))


def gap_stats(df: DataFrame, key: str, t: str = "t", tie: str = "event_id") -> DataFrame:
    gaps = df.withColumn("gap", F.col(t) - F.lag(t).over(by(key, t, tie))).where("gap is not null")
    return gaps.groupBy(key).agg(F.min("gap").alias("least"), F.percentile("gap", 0.5).alias("median"), F.max("gap").alias("most"))


def bursts(df: DataFrame, key: str, gap: float, t: str = "t", tie: str = "event_id") -> DataFrame:
    """Sessions: a new one begins when the gap is longer than ``gap``; an equal gap stays. key, burst, first, last, samples."""
    w = by(key, t, tie)
    begins = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    numbered = df.withColumn("begins", begins).withColumn("burst", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "burst").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("samples"))


def turn_arounds(df: DataFrame, key: str, order: list[str], value: str = "value", half: int = 40) -> DataFrame:
    """Samples at which the series turns, with their depth against the median of the samples around."""
    w = by(key, *order)
    around = w.rowsBetween(-half, half - 1)
    before, after = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    return df.withColumns({"turn": before * after, "depth": F.abs(F.col(value) - F.percentile(value, 0.5).over(around))}).where("turn < 0").drop("turn")


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(by(key, *order).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(df: DataFrame, key: str, order: list[str], value: str, half: int, name: str = "smooth", ends: str = "shrink") -> DataFrame:
    """Mean of the samples up to half before and after. ends: "shrink" takes those that exist, "same" counts missing ones as 0, "hold" repeats the first and the last."""
    around = by(key, *order).rowsBetween(-half, half)
    if ends == "shrink":
        return df.withColumn(name, F.avg(value).over(around))
    total = F.sum(value).over(around)
    if ends == "hold":
        first, last = by(key, *order).rowsBetween(Window.unboundedPreceding, 0), by(key, *order).rowsBetween(0, Window.unboundedFollowing)
        lacking = lambda n: F.greatest(F.lit(0), half + 1 - n)
        before, after = F.count(F.lit(1)).over(by(key, *order).rowsBetween(-half, 0)), F.count(F.lit(1)).over(by(key, *order).rowsBetween(0, half))
        total = total + lacking(before) * F.first(value).over(first) + lacking(after) * F.last(value).over(last)
    elif ends != "same":
        raise ValueError(f"ends must be shrink, same or hold, not {ends}")
    return df.withColumn(name, total / (2 * half + 1))


def step_outliers(df: DataFrame, tile: str, step: str, value: str, times: float, least: float = 0.5) -> DataFrame:
    """Steps at which the median over tiles of change / max(the tile's median change, least) exceeds times."""
    d = df.withColumn("change", F.abs(F.col(value) - F.lag(value).over(by(tile, step)))).where("change is not null")
    typical = F.percentile("change", 0.5).over(Window.partitionBy(tile))
    ratios = d.withColumn("ratio", F.col("change") / F.greatest(typical, F.lit(least)))
    return ratios.groupBy(step).agg(F.percentile("ratio", 0.5).alias("ratio"), F.count(F.lit(1)).alias("tiles")).where(F.col("ratio") > times)


def onsets(df: DataFrame, key: str, order: list[str], value: str = "value") -> DataFrame:
    """Local maxima of the positive change of log value above median + 3 standard deviations (population)."""
    w, whole = by(key, *order), Window.partitionBy(key)
    rise = F.log(F.col(value)) - F.lag(F.log(F.col(value))).over(w)
    r = df.withColumn("strength", F.when(rise.isNotNull(), F.greatest(rise, F.lit(0.0)))).where("strength is not null")
    r = r.withColumn("bar", F.percentile("strength", 0.5).over(whole) + 3 * F.stddev_pop("strength").over(whole))
    r = r.withColumns({"before": F.lag("strength").over(w), "after": F.lead("strength").over(w)})
    peak = (F.col("strength") > F.coalesce("before", F.lit(0.0))) & (F.col("strength") >= F.coalesce("after", F.lit(0.0)))
    return r.where((F.col("strength") > F.col("bar")) & peak).drop("before", "after")


def on_even_clock(df: DataFrame, key: str, step: float, t: str = "t", value: str = "value", tie: str = "event_id", held: tuple[int, int] | None = None) -> DataFrame:
    """Linear interpolation onto multiples of step between a series' first and last sample.

    held: (first tick, last tick) of a clock that goes beyond; there the first and the last value are held.

    A two-sided as-of join by one sort: each gap between neighbouring samples makes the clock ticks that
    fall into it, so no samples are joined with ticks. Of samples at one time the last counts.
    """
    one = df.groupBy(key, t).agg(F.max_by(value, tie).alias(value))
    w = by(key, t)
    gaps = one.withColumns({"t1": F.lead(t).over(w), "v1": F.lead(value).over(w)}).where("t1 is not null")
    ticks = F.sequence(F.ceil(F.col(t) / step), F.ceil(F.col("t1") / step) - 1)
    some = gaps.where(F.ceil(F.col(t) / step) <= F.ceil(F.col("t1") / step) - 1).withColumn("tick", F.explode(ticks))
    part = (F.col("tick") * step - F.col(t)) / (F.col("t1") - F.col(t))
    inner = some.select(key, "tick", (F.col(value) + part * (F.col("v1") - F.col(value))).alias(value))
    if held is None:
        return inner
    ends = one.groupBy(key).agg(F.min(F.struct(t, value)).alias("a"), F.max(F.struct(t, value)).alias("b"))
    up_to, from_ = F.ceil(F.col("a")[t] / step) - 1, F.ceil(F.col("b")[t] / step)
    low = ends.where(up_to >= held[0]).select(key, F.explode(F.sequence(F.lit(held[0]).cast("long"), up_to)).alias("tick"), F.col("a")[value].alias(value))
    high = ends.where(from_ <= held[1]).select(key, F.explode(F.sequence(from_, F.lit(held[1]).cast("long"))).alias("tick"), F.col("b")[value].alias(value))
    inside = inner.where((F.col("tick") >= held[0]) & (F.col("tick") <= held[1]))
    return inside.unionByName(low.where(F.col("tick") <= held[1])).unionByName(high.where(F.col("tick") >= held[0]))


def nearest_within(left: DataFrame, right: DataFrame, key: str, tolerance: float, t: str = "t", tie: str = "event_id") -> DataFrame:
    """Left rows with the nearest right time of the same key if it is nearer than tolerance; the earlier of equals.

    One sort of the union instead of a range join: the last right time at or before, and the first at or after.
    """
    l_ = left.select(key, F.col(t).alias("t"), F.col(tie).alias("id"), F.lit(None).cast("double").alias("rt"))
    r_ = right.select(key, F.col(t).alias("t"), F.lit(None).cast("long").alias("id"), F.col(t).alias("rt"))
    u = l_.unionByName(r_)
    back = F.last("rt", ignorenulls=True).over(by(key, "t").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("rt", ignorenulls=True).over(by(key, "t").rangeBetween(0, Window.unboundedFollowing))
    both = u.withColumns({"back": back, "ahead": ahead}).where("id is not null")
    pick = F.when(F.col("ahead").isNull() | (F.col("t") - F.col("back") <= F.col("ahead") - F.col("t")), F.col("back")).otherwise(F.col("ahead"))
    return both.withColumn("nearest", pick).where(F.abs(F.col("nearest") - F.col("t")) < tolerance).select(key, F.col("id").alias(tie), "t", "nearest")


def change_log(changes: DataFrame, step: str, rms: str = "rms", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a line "step rms" for each step, the steps of the largest changes): the log and its listing."""
    line = F.concat(F.col(step).cast("string"), F.lit(" "), F.format_string("%.6f", rms))
    return changes.select(step, line.alias("line")), changes.orderBy(F.desc(rms), step).limit(top)


def diff_rms(df: DataFrame, order: list[str], value: str, key: str, normalize: bool = False) -> DataFrame:
    """Root mean square change of each step over its keys; normalize divides by the step's largest change first."""
    d = df.withColumn("change", F.col(value) - F.lag(value).over(by(key, *order))).where("change is not null")
    agg = F.sqrt(F.avg(F.col("change") * F.col("change")))
    if normalize:
        agg = agg / F.greatest(F.max(F.abs("change")), F.lit(1e-12))
    return d.groupBy(*order).agg(agg.alias("rms"))
