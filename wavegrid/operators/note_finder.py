"""Notes in a recording, by deconvolution: which comb of overtones, at which pitch and when, explains the spectrogram.

The spectrogram, folded to a logarithmic axis, is a non-negative mix of fixed templates: for every pitch of
a fine scale the image of a note's overtones with a steep, a flat or no fall of their strength. One
non-negative least-squares problem is solved for all frames at once, so that notes that share overtones
are told apart by what only one of them explains. Its solution is a picture of pitch against time whose
ridges are the notes: ridge points are linked to a graph, its connected components are tones, and a tone
is cut where its own loudness jumps again. What still looks like another note's overtone is set aside by
one comparison of all pairs. Pitch comes from the partials' refined frequencies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavegrid.functions.music import NOTE_NAMES
from wavegrid.operators.signal import stft, whole

LOWEST = 27.5
#: Cells an octave of the folded spectrum and of the pitch scale.
CELLS = 36
#: Overtone h of a template has the strength h ** -slope.
SLOPES = (0.6, 1.6, 9.0)
#: How much of the best match a template must beat to be used; a lone partial explains anything and costs most.
COST = (0.02, 0.02, 0.05)
OVERTONES = 20
ROUNDS = 80


@dataclass
class Found:
    t0: float
    t1: float
    midi: float
    spread: float
    peak: float
    attack: float | None = None
    decay: float | None = None


def midi_of(hz: np.ndarray | float) -> np.ndarray | float:
    return 69 + 12 * np.log2(np.maximum(hz, 1e-6) / 440)


def refine(db: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of maxima at whole places i along the first axis of decibels, moved to the tops of parabolas."""
    left, top, right = (np.take_along_axis(db, np.clip(i + d, 0, len(db) - 1)[None], axis=0)[0] for d in (-1, 0, 1))
    bend = left - 2 * top + right
    return i + np.where(bend < 0, (left - right) / np.where(bend < 0, 2 * bend, 1), 0.0)


def _scale(hi: float) -> np.ndarray:
    return LOWEST * 2 ** (np.arange(int(CELLS * math.log2(hi / LOWEST)) + 1) / CELLS)


def _fold(mag: np.ndarray, step: float, scale: np.ndarray) -> np.ndarray:
    """Largest magnitude within each cell of a logarithmic scale."""
    half = 2 ** (0.5 / CELLS)
    edges = np.stack((np.floor(scale / half / step), np.ceil(scale * half / step) + 1), axis=1).astype(int)
    return np.maximum.reduceat(mag, np.minimum(edges, len(mag) - 1).ravel(), axis=0)[::2]


@lru_cache(maxsize=8)
def _templates(size: int, pad: int, sr: int, hi: float) -> np.ndarray:
    """cells x (slopes * pitches): folded images of notes; a Hann window of ``size`` samples makes each partial's shape."""
    step, scale = sr / pad, _scale(hi)
    f = np.arange(pad // 2 + 1) * step
    out = []
    for slope in SLOPES:
        for pitch in scale:
            line = np.zeros(len(f))
            for h in range(1, OVERTONES + 1):
                if h**-slope < 1e-3 or h * pitch > scale[-1]:
                    break
                at = slice(max(0, int((h * pitch - 3 * sr / size) / step)), int((h * pitch + 3 * sr / size) / step) + 2)
                off = (f[at] - h * pitch) * size / sr
                with np.errstate(divide="ignore", invalid="ignore"):
                    lobe = np.where(np.abs(np.abs(off) - 1) < 1e-6, 0.5, np.sinc(off) / (1 - off**2))
                line[at] = np.maximum(line[at], h**-slope * np.abs(lobe))
            out.append(_fold(line, step, scale))
    return np.array(out, np.float32).T


def activations(folded: np.ndarray, templates: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """pitches x frames: strength of each pitch, by multiplicative updates of a non-negative least-squares problem."""
    v = folded.astype(np.float32)
    gram, aim = templates.T @ templates, templates.T @ v
    scaled = aim / np.sqrt(gram.diagonal())[:, None]
    cost = np.repeat(np.array(COST, np.float32), len(aim) // len(SLOPES)) * np.sqrt(gram.diagonal())
    sparse = cost[:, None] * scaled.max(axis=0, keepdims=True)
    h = aim / gram.diagonal()[:, None]
    for _ in range(rounds):
        h *= np.maximum(aim - sparse, 0) / (gram @ h + 1e-9)
    return h.reshape(len(SLOPES), -1, h.shape[1]).sum(axis=0)


def _shifted(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """x moved by rows and columns; what comes in is 0."""
    out = np.zeros_like(x)
    h, w = x.shape
    out[max(rows, 0) : h + min(rows, 0), max(cols, 0) : w + min(cols, 0)] = x[max(-rows, 0) : h + min(-rows, 0), max(-cols, 0) : w + min(-cols, 0)]
    return out


def ridges(strength: np.ndarray, share: float = 0.08, quiet_db: float = -40.0) -> np.ndarray:
    """Ridge points: largest within 80 cents, and loud enough for their frame and for the recording."""
    near = np.max([_shifted(strength, d, 0) for d in (-2, -1, 1, 2)], axis=0)
    floor = np.maximum(share * strength.max(axis=0, keepdims=True), strength.max() * 10 ** (quiet_db / 20))
    return (strength > floor) & (strength >= near)


def components(points: np.ndarray, gap: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each connected group of points; neighbours are a row and ``gap`` columns apart at most."""
    label = np.where(points, np.arange(points.size).reshape(points.shape) + 1, 0)
    moves = [(r, c) for c in range(gap + 1) for r in (-1, 0, 1) if c or r > 0]
    while True:  # the smallest number spreads, twice a round through the points it names
        best = label.copy()
        for r, c in moves:
            for rows, cols in ((r, c), (-r, -c)):
                there = _shifted(label, rows, cols)
                best = np.where(points & (there > 0), np.minimum(best, there), best)
        best = np.where(points, best.ravel()[np.maximum(best - 1, 0)], 0)
        if (best == label).all():
            break
        label = best
    rows, cols = np.nonzero(points)
    groups = pd.Series(np.arange(len(rows))).groupby(label[rows, cols]).indices
    return [(rows[i], cols[i]) for i in groups.values()]


@dataclass
class Spectra:
    """A long window for pitch, a short one for time; ``at`` and ``when`` are the middles of their frames in seconds."""

    long: np.ndarray
    step: float
    at: np.ndarray
    short: np.ndarray
    short_step: float
    when: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, sr: int) -> Spectra:
        size = 1 << round(math.log2(0.15 * sr))
        small, hop = size // 4, size // 8
        middle = lambda spectrum, n, h: (np.arange(spectrum.shape[1]) * h + n / 2 - size) / sr
        x = np.pad(np.asarray(x, float), size)
        long, short = stft(x, size, hop, 2 * size), stft(x, small, small // 8, 2 * small)
        return cls(long, sr / (2 * size), middle(long, size, hop), short, sr / (2 * small), middle(short, small, small // 8))

    def onsets(self) -> np.ndarray:
        """Moments at which many frequencies grow at once."""
        rise = np.maximum(np.diff(np.log(self.short + 1e-3 * max(self.short.max(), 1e-9)), axis=1), 0).sum(axis=0)
        wide = np.max([np.roll(rise, k) for k in range(-4, 5)], axis=0)
        return self.when[1:][(rise == wide) & (rise > np.median(rise) + 2 * rise.std())]

    def loudness(self, midi: float, partials: int = 3) -> np.ndarray:
        """Log loudness over time of a pitch and its next overtones."""
        hz = 440 * 2 ** ((midi - 69) / 12) * np.arange(1, partials + 1)
        bins = np.rint(hz[hz < self.short_step * (len(self.short) - 2)] / self.short_step).astype(int)
        total = sum(self.short[max(b - 1, 0) : b + 2].max(axis=0) for b in bins)
        return np.log(total + 1e-4 * max(self.short.max(), 1e-9)) if len(bins) else np.zeros(len(self.when))

    def pitch(self, midi: float, frames: np.ndarray, partials: int = 3) -> np.ndarray:
        """MIDI pitch in each frame near a first guess: partials' refined frequencies, weighed by strength over number squared."""
        total, weight = np.zeros(len(frames)), np.zeros(len(frames))
        mag = self.long[:, frames]
        db = 20 * np.log10(mag + 1e-12)
        for h in range(1, partials + 1):
            b = h * 440 * 2 ** ((midi - 69) / 12) / self.step
            reach = max(1.5, b * (2 ** (0.5 / 12) - 1))
            lo, hi = max(1, round(b - reach)), round(b + reach) + 1
            if hi >= len(mag) - 1:
                break
            top = lo + mag[lo:hi].argmax(axis=0)
            w = np.take_along_axis(mag, top[None], axis=0)[0] / h**2
            total, weight = total + w * refine(db, top) * self.step / h, weight + w
        return midi_of(total / np.maximum(weight, 1e-12))


def _strikes(loud: np.ndarray, when: np.ndarray, onsets: np.ndarray, first: float, last: float) -> list[float]:
    """Moments from first to last at which a tone's loudness jumps; a later one needs an onset beside it, as beats and vibrato have none."""
    lag = 4
    rise = np.zeros(len(loud))
    rise[lag:-lag] = loud[2 * lag :] - loud[: -2 * lag]
    tops = np.flatnonzero((rise >= np.max([np.roll(rise, k) for k in range(-lag, lag + 1)], axis=0)) & (rise > 0.5) & (when >= first) & (when <= last))
    out: list[float] = []
    for i in tops:
        if not out:  # where the rise begins
            low = np.flatnonzero((rise[:i] < 0.4 * rise[i]) | (when[:i] < first))
            out.append(float(when[min(i, low[-1] + 1 + lag if len(low) else i)]))
        elif when[i] - out[-1] > 0.1 and len(onsets) and np.abs(onsets - when[i]).min() < 0.04:
            out.append(float(when[i]))
    return out


def grouped(midi: np.ndarray, peak: np.ndarray, most: int = 16) -> list[tuple[float, np.ndarray]]:
    """(pitch, members) of the sources of partial tones that one strike sounds, whose fundamental may be the faintest.

    A candidate is a tone, or what it would be the second to fourth overtone of; it gathers the tones on its
    overtones, and one that is no tone itself needs two neighbours among them. Each round takes the best.
    """
    left, out = np.arange(len(midi)), []
    while len(left):
        best = (0.0, 0.0, left[:0])
        for i in left:
            for k in (1, 2, 3, 4):
                base = midi[i] - 12 * math.log2(k)
                ratio = 2 ** ((midi[left] - base) / 12)
                number = np.rint(ratio)
                off = 1200 * np.abs(np.log2(ratio / np.maximum(number, 1)))
                own = (number >= 1) & (number <= most) & (off < np.minimum(45, 420 * np.log2(1 + 1 / np.maximum(number, 1))))
                if k > 1 and not (np.isin([k, k + 1], number[own]).all() and number[own].min() <= 3):
                    continue
                strength = float((peak[left[own]] / np.sqrt(number[own])).sum() / (1 if k == 1 else 1.2))
                if strength > best[0]:
                    best = strength, base, left[own]
        if out and best[0] < 0.25 * out[0][2]:
            break
        out.append((best[1], best[2], best[0]))
        left = np.setdiff1d(left, best[2])
    return [(pitch, members) for pitch, members, _ in out]


def _sources(notes: list[Found], s: Spectra) -> list[Found]:
    """Notes of one strike brought down to their sources."""
    notes = sorted(notes, key=lambda n: n.t0)
    cut = [0, *(i for i in range(1, len(notes)) if notes[i].t0 - notes[i - 1].t0 > 0.05), len(notes)]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        chord = notes[a:b]
        for pitch, members in grouped(np.array([n.midi for n in chord]), np.array([n.peak for n in chord])):
            own = [chord[i] for i in members]
            lead = min(own, key=lambda n: abs(n.midi - pitch))
            if abs(lead.midi - pitch) > 0.5:  # no partial of its own
                frames = np.flatnonzero((s.at >= lead.t0) & (s.at <= lead.t1))
                lead = Found(lead.t0, lead.t1, float(np.median(s.pitch(pitch, frames))) if len(frames) else pitch, lead.spread, lead.peak)
            lead.peak = max(n.peak for n in own)
            out.append(lead)
    return out


def find_notes(x: np.ndarray, sr: int, hi: float = 8000.0) -> list[Found]:
    """The notes of a recording in the order of (start, pitch)."""
    if not len(x) or not np.abs(x).max() > 0:
        return []
    hi = min(hi, 0.45 * sr)
    s = Spectra.of(x, sr)
    window = len(s.long) - 1
    folded = _fold(s.long[: int(hi * 1.05 / s.step) + 2], s.step, _scale(hi))
    strength = activations(folded / folded.max(), _templates(window, 2 * window, sr, hi)) * folded.max()
    near = strength + _shifted(strength, 1, 0) + _shifted(strength, -1, 0)  # a pitch between two cells is shared by them
    onsets = s.onsets()
    half = window / 2 / sr
    notes = []
    for rows, cols in components(ridges(near)):
        if len(np.unique(cols)) < 3:
            continue
        weight = near[rows, cols]
        guess = midi_of(_scale(hi)[rows[weight.argmax()]])
        begin, end = s.at[cols.min()] - half, s.at[cols.max()] + half / 2
        starts = _strikes(s.loudness(guess), s.when, onsets, begin, end - 0.06) or [begin + half / 2]
        level = lambda a, b: weight[(s.at[cols] >= a) & (s.at[cols] < b)].max(initial=0.0)  # noqa: B023, E731
        starts = starts[:1] + [t for t in starts[1:] if level(t, t + 0.25) > 1.3 * level(t - half, t - half / 2)]
        for a, b in zip(starts, [*starts[1:], math.inf], strict=True):
            own = (s.at[cols] >= a) & (s.at[cols] < b)
            if not own.any():
                continue
            loud = own & (weight >= 0.3 * weight[own].max())
            pitch = s.pitch(guess, np.unique(cols[loud]))
            q1, mid, q3 = np.percentile(pitch, [25, 50, 75])
            snapped = onsets[np.abs(onsets - a).argmin()] if len(onsets) and np.abs(onsets - a).min() < 0.06 else a
            stop = float(min(s.at[cols[own]].max() + half / 2, b))
            if stop - snapped >= 0.06:
                notes.append(Found(max(0.0, float(snapped)), stop, float(mid), float(q3 - q1) * 50, float(weight[own].max())))
    return _shaped(_distinct(_sources(notes, s), onsets), s)


def _distinct(notes: list[Found], onsets: np.ndarray) -> list[Found]:
    """Notes that are neither faint, nor a louder one's overtone, nor its double; every pair is compared once."""
    if not notes:
        return []
    t0, t1, midi, peak = (np.array([getattr(n, k) for n in notes]) for k in ("t0", "t1", "midi", "peak"))
    together = (t0[:, None] <= t1 + 0.05) & (t0 <= t1[:, None] + 0.05)
    with_start = together & (t0[:, None] >= t0 - 0.1)  # the row's note begins no earlier than the column's
    ratio = 2 ** ((midi[:, None] - midi) / 12)
    times = np.rint(ratio)
    reach = np.minimum(45, 420 * np.log2(1 + 1 / np.maximum(times, 1)))  # cents, well under the distance of neighbouring overtones
    overtone = (times >= 2) & (times <= 24) & (np.abs(1200 * np.log2(ratio / np.maximum(times, 1))) < reach) & with_start
    struck = np.abs(t0[:, None] - t0) < 0.08
    onset = (np.abs(t0[:, None] - onsets).min(axis=1, initial=math.inf) < 0.04)[:, None] & ~struck  # a strike of its own
    overtone &= peak[:, None] < np.where(onset, 0.25, np.where(times == 2, 0.7, 1.0)) * peak
    double = together & (np.abs(midi[:, None] - midi) < 1.5) & (struck | (peak[:, None] < 0.3 * peak))
    louder = (peak[:, None] < peak) | ((peak[:, None] == peak) & (np.arange(len(notes))[:, None] > np.arange(len(notes))))
    faint = (peak < 0.04 * peak.max()) | (peak < 0.12 * np.where(together, peak, 0).max(axis=1))
    drop = faint | (overtone & ~faint[None]).any(axis=1) | (double & louder).any(axis=1)
    return sorted((n for n, gone in zip(notes, drop, strict=True) if not gone), key=lambda n: (round(n.t0, 2), n.midi))


def _shaped(notes: list[Found], s: Spectra) -> list[Found]:
    """Adds each note's attack (seconds to its loudest moment) and decay (decibels a second from there), up to the next note."""
    starts = np.array([n.t0 for n in notes])
    for n in notes:
        later = starts[starts > n.t0 + 0.1]
        stop = min(n.t1 + 0.1, n.t0 + 1.0, later.min() if len(later) else math.inf)
        own = np.flatnonzero((s.when >= n.t0) & (s.when <= stop))
        if len(own) < 4:
            continue
        db = s.loudness(n.midi, 6)[own] * 20 / math.log(10)
        t, top = s.when[own], int(db.argmax())
        n.attack = float(t[top] - n.t0)
        if t[-1] - t[top] >= 0.25:
            n.decay = float(np.polyfit(t[top:], db[top:], 1)[0])
    return notes


# --- what a listener would say -----------------------------------------------------------------------


def explained(x: np.ndarray, sr: int, notes: list[Found], overtones: int = 40) -> tuple[float, float]:
    """(share of the energy on overtones of the notes that sound then, share of that beyond the fundamentals)."""
    s = Spectra.of(x, sr)
    power = s.long**2
    hz = np.arange(len(power)) * s.step
    first, on = np.zeros(power.shape, bool), np.zeros(power.shape, bool)
    for n in notes:
        sounding = (s.at >= n.t0) & (s.at <= n.t1)
        f = 440 * 2 ** ((n.midi - 69) / 12)
        number = np.rint(hz / f)
        partial = (number >= 1) & (number <= overtones) & (np.abs(hz - number * f) <= np.maximum(0.03 * f, 2 * s.step))
        on |= partial[:, None] & sounding[None]
        first |= (partial & (number == 1))[:, None] & sounding[None]
    whole_power, on_power = power.sum(), power[on].sum()
    return float(on_power / max(whole_power, 1e-12)), float(1 - power[first].sum() / max(on_power, 1e-12)) if on_power else 0.0


def character(notes: list[Found], tonal: float | None = None, bright: float | None = None) -> str:
    """One line on how the notes begin, fade and waver, and on overtones and noise where their shares are given."""
    if not notes:
        return "no notes"
    middle = lambda name, other: float(np.median([v for n in notes if (v := getattr(n, name)) is not None] or [other]))
    attack, decay, spread = middle("attack", 0.0), middle("decay", 0.0), middle("spread", 0.0)
    said = [
        "struck or plucked starts" if attack < 0.05 else "soft starts" if attack < 0.2 else "slow starts",
        "held notes" if decay > -3 else "fading notes" if decay > -25 else "short notes",
        "steady pitch" if spread < 10 else "wavering pitch",
    ]
    if bright is not None:
        said.append("nearly pure tones" if bright < 0.1 else "some overtones" if bright < 0.5 else "rich overtones")
    if tonal is not None:
        said.append("little noise" if tonal > 0.8 else "some noise" if tonal > 0.5 else "much noise")
    return ", ".join(said)


def in_words(notes: list[Found], line: str) -> str:
    """The notes as text: a head line, then start, name, cents and length of each."""
    rows = [f"{len(notes)} notes; {line}"]
    for n in notes:
        nearest = round(n.midi)
        cents = round((n.midi - nearest) * 100)
        rows.append(f"{n.t0:7.2f} s  {NOTE_NAMES[nearest % 12]}{nearest // 12 - 1}" + (f" {cents:+d} cents" if cents else "") + f"  {n.t1 - n.t0:.2f} s")
    return "\n".join(rows) + "\n"


_COLUMNS = ["stem", "t0", "t1", "midi", "spread", "peak", "attack", "decay"]


def find(signal: DataFrame) -> DataFrame:
    """stem, t0, t1, midi, spread, peak, attack, decay of each note in each recording."""

    def kernel(stem, sr, x):
        return pd.DataFrame([(stem, n.t0, n.t1, n.midi, n.spread, n.peak, n.attack, n.decay) for n in find_notes(x, sr)], columns=_COLUMNS)

    return whole(signal, kernel, "stem string, t0 double, t1 double, midi double, spread double, peak double, attack double, decay double")


def describe(signal: DataFrame) -> DataFrame:
    """stem, character and the notes in words of each recording."""

    def kernel(stem, sr, x):
        notes = find_notes(x, sr)
        line = character(notes, *explained(x, sr, notes)) if notes else character(notes)
        return pd.DataFrame([(stem, line, in_words(notes, line))], columns=["stem", "character", "words"])

    return whole(signal, kernel, "stem string, character string, words string")
