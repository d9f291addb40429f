"""Numeric and text expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def linspace(lo: float, hi: float, n: int) -> Column:
    """Array of n evenly spaced numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * F.lit((hi - lo) / max(n - 1, 1)))


def geomspace(lo: float, hi: float, n: int) -> Column:
    """Array of n numbers with even ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) * F.pow(F.lit(hi / lo), i / F.lit(float(max(n - 1, 1)))))


def nice_step(span: Column, target: int) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten that gives about target ticks."""
    raw = span / target
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.coalesce(*[F.when(m * power >= raw, m * power) for m in (1.0, 2.0, 5.0)], 10.0 * power)


def clock(seconds: Column) -> Column:
    """HH:MM:SS.ss"""
    return F.format_string("%02d:%02d:%05.2f", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60.0)


def short_clock(seconds: Column) -> Column:
    """M:SS"""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def place_words(cx: Column, cy: Column) -> Column:
    """Thirds of the picture in words."""
    third = lambda c, a, b, d: F.element_at(F.array(F.lit(a), F.lit(b), F.lit(d)), F.least(F.lit(2), F.floor(c * 3).cast("int")) + 1)
    return F.concat_ws(" ", third(cy, "upper", "middle", "lower"), third(cx, "left", "centre", "right"))


def parse_options(text: Column) -> Column:
    """map of 'key=val,key=val'; parts without = are skipped, the first = splits, both sides are trimmed, the last of equal keys wins."""
    pairs = F.filter(F.split(text, ","), lambda p: F.contains(p, F.lit("=")))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def limit_denominator(value: Column, largest: int = 999) -> Column:
    """'num/den' of the nearest fraction with den <= largest; the smallest den of equals."""
    tried = F.transform(F.sequence(F.lit(1), F.lit(largest)), lambda d: F.struct(F.round(F.abs(F.bround(value * d) / d - value), 15).alias("off"), d.alias("den"), F.bround(value * d).cast("long").alias("num")))
    best = F.array_min(tried)
    return F.concat(best["num"].cast("string"), F.lit("/"), best["den"].cast("string"))


def variable_length(n: Column) -> Column:
    """MIDI variable-length quantity as hex: groups of 7 bits, all but the last with the high bit set."""
    out = F.lpad(F.hex(n % 128), 2, "0")
    for shift in (7, 14, 21):
        group = F.shiftright(n, shift)
        out = F.when(group > 0, F.concat(F.lpad(F.hex(group % 128 + 128), 2, "0"), out)).otherwise(out)
    return F.lower(out)
