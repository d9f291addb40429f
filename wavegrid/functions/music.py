"""Pitch, scale and colour arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavegrid.functions.tables import NOTE_NAMES


def hz_to_midi(hz: Column) -> Column:
    return 69.0 + 12.0 * F.log2(F.greatest(hz, F.lit(1e-6)) / 440.0)


def midi_to_hz(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69.0) / 12.0)


def midi_name(midi: Column) -> Column:
    """C4 for 60."""
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, F.pmod(midi, F.lit(12)).cast("int") + 1), (F.floor(midi / 12) - 1).cast("string"))


def hz_name(hz: Column) -> Column:
    """Name of the nearest note; halves go to the even one."""
    return midi_name(F.bround(hz_to_midi(hz)).cast("int"))


def name_to_midi(name: Column) -> Column:
    """60 for C4; case does not matter, a missing octave is 4, a bad name is an error."""
    part = lambda i: F.regexp_extract(F.upper(F.trim(name)), r"^([A-G]#?)(-?\d*)$", i)
    pitch = F.array_position(F.array(*[F.lit(n) for n in NOTE_NAMES]), part(1)) - 1
    octave = F.when(part(2) == "", F.lit(4)).otherwise(part(2).try_cast("int"))
    bad = F.raise_error(F.concat(F.lit("bad note name: "), name)).cast("int")
    return F.when(pitch < 0, bad).otherwise((12 * (octave + 1) + pitch).cast("int"))


def cents_off(hz: Column) -> Column:
    """Distance to the nearest equal-tempered note."""
    m = hz_to_midi(hz)
    return 100.0 * (m - F.bround(m))


def nearest(x: Column, candidates: Sequence[float]) -> Column:
    """The candidate that is nearest to x, the first of equals: a chain of comparisons inside generated code."""
    best, least = F.lit(float(candidates[0])), F.abs(x - float(candidates[0]))
    for c in candidates[1:]:
        d = F.abs(x - float(c))
        best, least = F.when(d < least, F.lit(float(c))).otherwise(best), F.least(d, least)
    return best


def snap_semitone(midi: Column, root: float, scale: Sequence[int]) -> Column:
    """MIDI number of the nearest degree of an equal-tempered scale."""
    octave = F.floor((midi - root) / 12.0)
    return (root + octave * 12 + nearest(midi - root - octave * 12.0, [*scale, 12])).cast("int")


def snap_ratio(hz: Column, root: float, ratios: Sequence[float]) -> Column:
    """Hz of the nearest degree of a ratio scale, by distance of logarithms; the root for hz <= 0."""
    import math

    octave = F.floor(F.log2(hz / root))
    within = F.log2(hz / root) - octave
    degrees = [*ratios, 2.0]
    logs = [math.log2(r) for r in degrees]
    best, least = F.lit(degrees[0]), F.abs(within - logs[0])
    for r, log in zip(degrees[1:], logs[1:], strict=True):
        d = F.abs(within - log)
        best, least = F.when(d < least, F.lit(r)).otherwise(best), F.least(d, least)
    return F.when(hz <= 0, F.lit(float(root))).otherwise(root * F.pow(F.lit(2.0), octave) * best)


def octave_rgb(hz: Column) -> list[Column]:
    """Red, green, blue in [0, 1]: hue 0 to 300 degrees over each octave above 400 THz folded down."""
    start = 400e12
    place = F.pmod(F.log2(hz / start), F.lit(1.0))
    h = place * 5.0
    x = 1.0 - F.abs(h % 2.0 - 1.0)
    segment = F.floor(h) % 6
    one, zero = F.lit(1.0), F.lit(0.0)
    pick = lambda *v: F.element_at(F.array(*v), (segment + 1).cast("int"))
    return [pick(one, x, zero, zero, x, one), pick(x, one, one, x, zero, zero), pick(zero, zero, x, one, one, x)]


def fold_fifths(steps: Column) -> Column:
    """Ratio of so many pure fifths, folded into [1, 2)."""
    r = F.pow(F.lit(1.5), steps)
    return r / F.pow(F.lit(2.0), F.floor(F.log2(r) + 1e-12))
