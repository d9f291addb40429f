"""Words, word hashes and word windows of many texts at once, in NumPy.

Words are runs of bytes other than the six ASCII white spaces. Hashes are 64-bit: a polynomial over the
word's bytes, finished by a mixing function, so that equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from wavegrid.llm._store import ship

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Texts are taken together until they have this many bytes; bounds the temporary arrays.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which every bit depends on all (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def chunks(texts: list[bytes | None], most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of ``most`` texts at most and about CHUNK_BYTES together; one longer text is a range of its own."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        n = len(x or b"") + 1
        if i > start and (total + n > CHUNK_BYTES or i - start >= most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def spaced(texts: list[bytes | None], lower: bool = True) -> list[bytes]:
    """The words of each text, one space apart, closed by a newline."""
    return [b" ".join((x.translate(LOWER) if lower else x).split()) + b"\n" if x else b"\n" for x in texts]


class Words:
    """The words of some texts: hash, and the number of their text."""

    def __init__(self, texts: list[bytes | None], lower: bool = True, rows: list[bytes] | None = None) -> None:
        """rows: the texts as ``spaced`` gives them, if at hand."""
        rows = spaced(texts, lower) if rows is None else rows
        self.n = len(rows)
        buf = np.frombuffer(b"".join(rows), dtype=np.uint8)
        ends = np.flatnonzero((buf == 32) | (buf == 10))
        starts = np.concatenate((np.zeros(1, dtype=ends.dtype), ends[:-1] + 1)) if len(ends) else ends
        real = ends > starts
        starts, ends = starts[real], ends[real]
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[buf] * up[: len(buf)], out=sums[1:])
        self.hash = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        last = np.cumsum([len(r) for r in rows])
        self.text = np.searchsorted(last, starts, side="right")
        self.counts = np.bincount(self.text, minlength=self.n)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every window of so many words in a row."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            h = (h + self.hash[j : j + n]) * np.uint64(0xD1342543DE82EF95)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return mix64(h[at] + np.uint64(width)), self.text[at]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows; a text with fewer words, but one at least, has its whole sequence as the only one."""
        parts = [self.windows(width)]
        first = np.cumsum(self.counts) - self.counts
        for k in range(1, width):
            short = np.flatnonzero(self.counts == k)
            h = np.zeros(len(short), dtype=np.uint64)
            for j in range(k):
                h = (h + self.hash[first[short] + j]) * np.uint64(0xD1342543DE82EF95)
            parts.append((mix64(h + np.uint64(k)), short))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def text_sets(texts: list[bytes | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct shingle hashes) of each text that has words, in order."""
    for a, b in chunks(texts):
        h, t = Words(texts[a:b]).shingles(width)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[new], t[new]
        cut = np.flatnonzero(np.diff(t)) + 1
        for i, s in zip(t[np.concatenate(([0], cut))] if len(t) else [], np.split(h, cut), strict=False):
            yield a + int(i), s


ship(__name__)
