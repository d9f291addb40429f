"""Spectra of evenly and unevenly sampled series as relations (series, rate, power), and what is read off them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dft_power(df: DataFrame, key: str, step: str, value: str, bins: int, length: int, hann: bool = False) -> DataFrame:
    """|DFT|^2 of value - mean at bins 1..bins of a series of the given length; missing steps count as the mean.

    Each sample fans out over the bins inside its own task and the sums are pre-aggregated there, so the
    shuffle carries one row per series, bin and task.
    """
    x = df.withColumn("x", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    if hann:
        x = x.withColumn("x", F.col("x") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col(step) / (length - 1))))
    fanned = x.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    angle = F.lit(2 * math.pi) * ((F.col("bin") * F.col(step)) % length) / length
    sums = fanned.groupBy(key, "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return sums.select(key, "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def peaks(spectrum: DataFrame, key: str, order: str, value: str, rule: str = "strict", floor: float = 0.0) -> DataFrame:
    """Local maxima. rule: strict (> both sides), left (> left, >= right), floor (as left and > floor), plateau (>= both, height >= floor)."""
    w = Window.partitionBy(key).orderBy(order)
    v, a, b = F.col(value), F.col("_before"), F.col("_after")
    tests = {"strict": (v > a) & (v > b), "left": (v > a) & (v >= b), "floor": (v > a) & (v >= b) & (v > floor), "plateau": (v >= a) & (v >= b) & (v >= floor)}
    sided = spectrum.withColumns({"_before": F.lag(value).over(w), "_after": F.lead(value).over(w)})
    return sided.where(tests[rule]).drop("_before", "_after")


def refined(spectrum: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds shift: the vertex of the parabola through a bin and its neighbours; 0 at the ends and on a line."""
    w = Window.partitionBy(key).orderBy(order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    den = a - 2 * b + c
    return spectrum.withColumn("shift", F.coalesce(F.when(F.abs(den) > 1e-12, 0.5 * (a - c) / den), F.lit(0.0)))


def local_ratio(spectrum: DataFrame, key: str, bin_: str, value: str, near: int = 3, far: int = 15) -> DataFrame:
    """Adds ratio: the value over the median of the bins near..far away, as many on each side as both have (near + 4 at least).

    Neighbours come from two row frames, no self join.
    """
    w = Window.partitionBy(key).orderBy(bin_)
    below, above = F.collect_list(value).over(w.rowsBetween(-far, -near)), F.collect_list(value).over(w.rowsBetween(near, far))
    sided = spectrum.withColumns({"_l": below, "_r": above})
    n = F.least(F.size("_l"), F.size("_r"))
    around = F.array_sort(F.concat(F.slice(F.reverse("_l"), F.lit(1), n), F.slice("_r", F.lit(1), n)))
    sided = sided.withColumn("_n", n).where(F.col("_n") >= 4).withColumn("_a", around)
    median = (F.element_at("_a", F.col("_n")) + F.element_at("_a", F.col("_n") + 1)) / 2
    return sided.withColumn("ratio", F.col(value) / F.greatest(median, F.lit(1e-12))).drop("_l", "_r", "_n", "_a")


def luck(ratio, tests: int):
    """Chance that the best of so many noise bins reaches a ratio to the local median: each doubles away with 2^-ratio."""
    return F.least(F.lit(1.0), tests * F.pow(F.lit(2.0), -ratio))


def line_share(spectrum: DataFrame, key: str, bin_: str, value: str, half: int = 2) -> DataFrame:
    """Adds share: the power within half bins over the series' whole power."""
    near = F.sum(value).over(Window.partitionBy(key).orderBy(bin_).rowsBetween(-half, half))
    return spectrum.withColumn("share", near / F.sum(value).over(Window.partitionBy(key)))


def common_rates(best: DataFrame, key: str, bin_: str, most: float) -> DataFrame:
    """Bins that more than ``most`` of all series have as their best: (bin, share of series)."""
    n = best.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    return best.groupBy(bin_).agg(F.countDistinct(key).alias("k")).crossJoin(F.broadcast(n)).select(bin_, (F.col("k") / F.col("n")).alias("share")).where(F.col("share") > most)


def not_near(df: DataFrame, rates: DataFrame, on: str, width: float) -> DataFrame:
    """Rows whose rate is further than width from every listed rate: rates are put into cells of that width, no range join."""
    cell = F.floor(F.col(on) / width)
    listed = rates.select(F.col(on).alias("_rate"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    return df.join(listed, (cell == F.col("_cell")) & (F.abs(F.col(on) - F.col("_rate")) <= width), "left_anti")


def comb(rates: DataFrame, rate: str, bases: list[float], tolerance: float, least: int = 4) -> DataFrame:
    """The base of which most rates are multiples, the smallest of equals; none with fewer than ``least``: base, multiples."""
    tried = rates.withColumn("base", F.explode(F.array(*[F.lit(b) for b in bases])))
    k = F.bround(F.col(rate) / F.col("base"))
    hits = tried.where((k >= 1) & (F.abs(F.col(rate) - k * F.col("base")) <= tolerance))
    counted = hits.groupBy("base").agg(F.count(F.lit(1)).alias("multiples")).where(F.col("multiples") >= least)
    best = F.max_by(F.struct("base", "multiples"), F.struct("multiples", -F.col("base")))
    return counted.agg(best.alias("b")).where("b is not null").select("b.*")


def multiples_of(rates: DataFrame, rate: str, base: DataFrame, tolerance: float, most: int = 3) -> DataFrame:
    """rate, m: the least m up to ``most`` for which rate * m is a multiple of a comb's base (one row, column base), within the tolerance."""
    tried = rates.crossJoin(F.broadcast(base.select("base"))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(most))))  # one row
    k = F.bround(F.col(rate) * F.col("m") / F.col("base"))
    hits = tried.where((k >= 1) & (F.abs(F.col(rate) * F.col("m") - k * F.col("base")) <= tolerance))
    return hits.groupBy(rate).agg(F.min("m").alias("m"))


def strong_lines(power: DataFrame, key: str, first_bin: int, times: float = 20.0) -> DataFrame:
    """Bins from first_bin on with over ``times`` the median power of those bins of their series."""
    use = power.where(F.col("bin") >= first_bin)
    middle = use.groupBy(key).agg(F.percentile("power", 0.5).alias("__m"))  # a spectrum's bins
    return use.join(middle, key).where(F.col("power") > times * F.col("__m")).drop("__m")


def phase_concentration(df: DataFrame, key: str, t: str, rate: float) -> DataFrame:
    """Length and angle of the mean of exp(2 pi i t rate) over each series."""
    a = 2 * math.pi * rate * F.col(t)
    sums = df.groupBy(key).agg(F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    return sums.select(key, F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("length"), F.atan2("s", "c").alias("angle"))


def sine_fit(df: DataFrame, key: str, t: str, value: str, rate: float) -> DataFrame:
    """Amplitude of the least-squares sine of a rate through value - mean: 2 x 2 normal equations from sums."""
    a = 2 * math.pi * rate * F.col(t)
    x = df.withColumns({"x": F.col(value) - F.avg(value).over(Window.partitionBy(key)), "s": F.sin(a), "c": F.cos(a)})
    m = x.groupBy(key).agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("s", "s"), ("s", "c"), ("c", "c"), ("x", "s"), ("x", "c"))])
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    p, q = (F.col("xs") * F.col("cc") - F.col("xc") * F.col("sc")) / det, (F.col("xc") * F.col("ss") - F.col("xs") * F.col("sc")) / det
    return m.where(F.abs(det) > 1e-9).select(key, F.sqrt(p * p + q * q).alias("amplitude"))


def lomb_scargle(df: DataFrame, key: str, t: str, value: str, rates: list[float]) -> DataFrame:
    """Normalised Lomb-Scargle power of uneven series at the given rates, with the usual phase offset.

    Sums of sines and cosines per (series, rate) are enough; the offset rotates them afterwards.
    """
    x = df.withColumn("x", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    x = x.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    a = 2 * math.pi * F.col("rate") * F.col(t)
    x = x.withColumns({"s": F.sin(a), "c": F.cos(a)})
    m = x.groupBy(key, "rate").agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("s", "s"), ("s", "c"), ("c", "c"), ("x", "s"), ("x", "c"), ("x", "x"))])
    half = 0.5 * F.atan2(2 * F.col("sc"), F.col("cc") - F.col("ss"))
    m = m.withColumns({"co": F.cos(half), "si": F.sin(half)})
    xc, xs = F.col("xc") * F.col("co") + F.col("xs") * F.col("si"), F.col("xs") * F.col("co") - F.col("xc") * F.col("si")
    mixed = 2 * F.col("sc") * F.col("co") * F.col("si")
    cc = F.col("cc") * F.col("co") * F.col("co") + F.col("ss") * F.col("si") * F.col("si") + mixed
    ss = F.col("ss") * F.col("co") * F.col("co") + F.col("cc") * F.col("si") * F.col("si") - mixed
    return m.where("xx > 0").select(key, "rate", ((xc * xc / F.greatest(cc, F.lit(1e-12)) + xs * xs / F.greatest(ss, F.lit(1e-12))) / F.col("xx")).alias("power"))
