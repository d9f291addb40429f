"""Operator 3, LM scoring: context-tree weighting over bytes, binary-decomposed.

A text becomes its lower-cased words, one space apart, closed by a newline as the end. Every byte is
eight binary decisions; each decision has a tree of contexts of its own, the DEPTH bytes before it, read
backwards. All training texts are counted at every node of every tree. A node's Krichevsky-Trofimov
estimate of its own counts and the product of its children's weighted probabilities share its weight
half and half (Willems, Shtarkov and Tjalkens), which gives each node the weight of stopping there; a
text's code length is the sum over its decisions of the so mixed estimates, in log10 probability (or
bits per byte). Where training has never seen a deeper context, the mixture stops at the deepest seen.

The counts are exact and unbounded: blocks of documents send their distinct (DEPTH + 1)-grams and words
to the ranges that own them (``_blocks``), a range holds all contexts that end in the same three bytes and
so whole subtrees, and answers each block with the code lengths of its own grams. A range works through
its grams in slices of whole subtrees. Only the nodes of depths 0 to 2 are summed at the driver: at most
one count for each three bytes and one sum for each of the 2**16 * 255 nodes, whatever the input's size.

Defined cases: null text counts as empty and holds the end only; without training rows every decision
costs one bit; repeated rows are scored alike and each is counted; an empty table gives an empty
result; a null doc_id is a row like others; extra columns are ignored.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm import _blocks as B
from wavegrid.llm._store import give_back, materialise, share, ship
from wavegrid.llm._text import Words, chunks, mix64, spaced

#: Bytes of context. A gram, DEPTH bytes and the next, is packed newest context byte first, next byte last.
DEPTH = 6
#: Depths 0 to TOP are summed at the driver; below them, subtrees belong to ranges.
TOP = 2
#: Grams that a range works on at once, about.
SLICE = 1 << 17
#: Runs of ranges that a block's keys are gathered, sent and looked up in.
PARTS = 16
_GRAM, _WORD, _NODE = 0, 1, 2


#: Texts that are scored together: a gram of DEPTH + 1 bytes and a text's number fill 64 bits, which sort without an index.
TOGETHER = 1 << (8 * (7 - DEPTH))
#: Texts that are worked on at once; the temporary arrays hold many times their bytes.
FEW = TOGETHER // 2


def stream(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram that ends at each byte, number of bytes) of spaced texts; contexts before a text's start are zero bytes."""
    pad = bytes(DEPTH)
    data = bytes(8 - DEPTH - 1) + pad + pad.join(rows)
    n = np.array([len(r) for r in rows])
    keep = np.ones(len(data) - 7, bool)
    first = np.cumsum(n + DEPTH) - n - DEPTH
    for back in range(DEPTH):
        keep[first[1:] - 1 - back] = False
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))[keep]  # the eight bytes up to each, the newest in front
    return (eight << np.uint64(8)) >> np.uint64(64 - 8 * DEPTH) << np.uint64(8) | eight >> np.uint64(56), n


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) for x >= 0.5: Stirling's series after shifting x above 10."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    inv = 1 / y
    series = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


_SMALL = 4096
_HALF, _WHOLE = _log_gamma(np.arange(_SMALL) + 0.5), _log_gamma(np.arange(_SMALL) + 1.0)


def _looked_up(n: np.ndarray, known: np.ndarray, offset: float) -> np.ndarray:
    out = known[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        out[large] = _log_gamma(n[large] + offset)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return _looked_up(a, _HALF, 0.5) + _looked_up(b, _HALF, 0.5) - math.log(math.pi) - _looked_up(a + b, _WHOLE, 1.0)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, bit), each n x 8: the partial byte, with a leading one, before each decision, and the decision."""
    byte = byte.astype(np.int64)[:, None]
    at = np.arange(8)
    return (1 << at) | (byte >> (8 - at)), (byte >> (7 - at)) & 1


class Subtree:
    """Depths TOP + 1 to DEPTH over distinct grams in ascending order.

    For one decision the deepest nodes are runs of grams, as grams ascend by context and byte; each
    shallower level groups the nodes below it. ones and seen are n x 8: the mixed probability of a one
    from depth TOP + 1 down, and whether training has seen that node. nodes and weighted are the parents
    of the nodes of depth TOP + 1, (newest TOP context bytes << 8 | path), and the nodes' weighted log probabilities.
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray) -> None:
        n = len(gram)
        path, bit = decisions((gram & np.uint64(255)).astype(np.int64))
        deepest = (gram >> np.uint64(8)).astype(np.int64)
        fresh = np.concatenate(([True], deepest[1:] != deepest[:-1]))
        self.ones, self.seen = np.empty((n, 8)), np.empty((n, 8), bool)
        nodes, weighted = [], []
        for j in range(8):
            start = np.flatnonzero(fresh | np.concatenate(([True], path[1:, j] != path[:-1, j])))
            context, way = deepest[start], path[start, j]
            b = np.add.reduceat(count * bit[:, j], start).astype(np.float64)
            a = np.add.reduceat(count, start) - b
            whole = log_kt(a, b)
            at = np.arange(len(start))  # node of the current depth above each deepest node
            mixed, known = (b + 0.5) / (a + b + 1.0), a + b > 0
            for _ in range(DEPTH - TOP - 1):
                context = context >> 8
                up, keys = pd.factorize((context << 8) | way)
                m = len(keys)
                a, b, rest = (np.bincount(up, weights=x, minlength=m) for x in (a, b, whole))
                context, way = keys >> 8, keys & 255
                own = log_kt(a, b)
                whole = np.logaddexp(own, rest) - math.log(2)
                stop, kt, at = np.exp(own - whole) / 2, (b + 0.5) / (a + b + 1.0), up[at]
                mixed = np.where(known, stop[at] * kt[at] + (1 - stop[at]) * mixed, kt[at])
                known = (a + b > 0)[at]
            size = np.diff(np.append(start, n))
            self.ones[:, j], self.seen[:, j] = np.repeat(mixed, size), np.repeat(known, size)
            nodes.append((context >> 8) << 8 | way)
            weighted.append(whole)
        self.nodes, self.weighted = np.concatenate(nodes), np.concatenate(weighted)


class Top:
    """Depths 0 to TOP, from the counts of TOP context bytes and the next, and the weighted probabilities below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, nodes: np.ndarray, weighted: np.ndarray) -> None:
        """grams: context bytes, the newest first, then the byte; nodes: the same context bytes, then the path."""
        contexts = np.unique(grams >> 8)
        #: Row of each TOP context bytes in the tables of depth TOP; unseen ones share the last.
        self.slot = np.full(1 << (8 * TOP), len(contexts), np.int32)
        self.slot[contexts] = np.arange(len(contexts))
        self.kt, self.stop, self.seen = [], [], []
        path, bit = decisions(grams & 255)
        rest = np.bincount(self.slot[nodes >> 8].astype(np.int64) << 8 | (nodes & 255), weights=weighted, minlength=(len(contexts) + 1) << 8).reshape(-1, 256)
        for depth in range(TOP, -1, -1):
            row, rows = self._rows(grams >> 8, depth), len(rest)
            at = ((row[:, None] << 8) | path).ravel()
            weight, ones = np.repeat(counts, 8), bit.ravel() == 1
            b, a = (np.bincount(at[x], weights=weight[x], minlength=rows << 8).reshape(-1, 256) for x in (ones, ~ones))
            own = log_kt(a, b)
            whole = np.logaddexp(own, rest) - math.log(2)
            self.kt.insert(0, (b + 0.5) / (a + b + 1)), self.stop.insert(0, np.exp(own - whole) / 2), self.seen.insert(0, a + b > 0)
            if depth:
                up = self._rows(contexts, depth - 1) if depth == TOP else np.arange(rows) >> 8
                rest = np.zeros((1 << (8 * (depth - 1)), 256))
                np.add.at(rest, up, whole[: len(up)])

    def _rows(self, context: np.ndarray, depth: int) -> np.ndarray:
        """Rows of a depth's tables for TOP context bytes."""
        return self.slot[context].astype(np.int64) if depth == TOP else context.astype(np.int64) >> (8 * (TOP - depth))

    def code(self, gram: np.ndarray, p: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte."""
        path, bit = decisions((gram & np.uint64(255)).astype(np.int64))
        context = (gram >> np.uint64(8 * (DEPTH + 1 - TOP))).astype(np.int64)
        for depth in range(TOP, -1, -1):
            at = (self._rows(context, depth)[:, None], path)
            kt, stop = self.kt[depth][at], self.stop[depth][at]
            p = np.where(seen, stop * kt + (1 - stop) * p, kt)
            seen = self.seen[depth][at]
        return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def _gram_range(gram: np.ndarray, ranges: int) -> np.ndarray:
    """Grams whose contexts end in the same TOP + 1 bytes share a range."""
    return (mix64(gram >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(ranges)).astype(np.int64)


def _slices(gram: np.ndarray) -> Iterator[slice]:
    """Slices of about SLICE ascending grams, of whole subtrees each."""
    subtree = gram >> np.uint64(8 * (DEPTH - TOP))
    start = 0
    while start < len(gram):
        stop = int(np.searchsorted(subtree, subtree[min(start + SLICE, len(gram)) - 1], side="right"))
        yield slice(start, stop)
        start = stop


def _ranges_of(kind: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    return _gram_range(keys, ranges) if kind == _GRAM else B.range_of(keys, ranges)


def _by_range(r: np.ndarray) -> np.ndarray:
    """A stable order by range; short integers are sorted by radix."""
    return np.argsort(r.astype(np.uint16) if not len(r) or r.max() < 1 << 16 else r, kind="stable")


def _few(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, spaced texts) of FEW rows at most."""
    for start in range(0, t.num_rows, FEW):
        rows = spaced(B.texts_of(t.slice(start, FEW)))
        for a, b in chunks(rows, FEW):
            yield start + a, start + b, rows[a:b]


class _Tallies:
    """Distinct keys of a block with their counts, in PARTS runs of whole ranges, so that no step works on all keys at once."""

    def __init__(self, kind: int, ranges: int) -> None:
        self.kind, self.ranges = kind, ranges
        self.parts = [B.Tally() for _ in range(min(PARTS, ranges))]

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """keys ascend, without repeats; without counts, only the keys matter."""
        part = (_ranges_of(self.kind, keys, self.ranges) * len(self.parts) // self.ranges).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        keys, counts = keys[order], None if counts is None else counts[order]
        ends = np.cumsum(np.bincount(part, minlength=len(self.parts)))
        for tally, a, b in zip(self.parts, [0, *ends[:-1]], ends, strict=True):
            if a < b:
                tally.add(keys[a:b], None if counts is None else counts[a:b])

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(ranges, keys, counts) of each part, by range, then key; a part is forgotten as it is given."""
        while self.parts:
            k, c = self.parts.pop(0).total()
            r = _ranges_of(self.kind, k, self.ranges)
            order = _by_range(r)
            yield r[order], k[order], None if c is None else c[order]


def _sender(ranges: int):
    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {kind: _Tallies(kind, ranges) for kind in (_GRAM, _WORD)}
        for t in batches:
            learn = np.array(t.column("learn").to_pylist(), bool)
            for a, b, rows in _few(t):
                gram, n = stream(rows)
                w = Words([], rows=rows)
                for kind, x, taught in ((_GRAM, gram, np.repeat(learn[a:b], n)), (_WORD, w.hash, learn[a:b][w.text])):
                    for part in (taught, ~taught):
                        u, c = B.counted(x[part])
                        found[kind].add(u, c if part is taught else np.zeros(len(u), np.int64))
                del rows, gram, w, x, taught, part, u, c
            del t
        for kind, tallies in found.items():
            for r, k, c in tallies.drain():
                yield from B.table(B.entries(key[0].as_py(), kind, r, k, c.astype(np.uint64)), B.ENTRY_FIELDS).to_batches()
                del r, k, c
        give_back(collect=False)

    return send


def _merged(t, kind: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(block of each entry, its keys, all distinct keys, their counts)."""
    mine = [i for i, k in enumerate(t.column("kind").to_pylist()) if k == kind]
    blocks, blobs, counts = (t.column(c).to_pylist() for c in ("block", "keys", "counts"))
    keys = [B.unpack_keys(blobs[i]) for i in mine]
    k, c = B.summed(keys, [B.unpack(counts[i], np.uint64) for i in mine])
    return [blocks[i] for i in mine], keys, k, c


def _top_parts(t):
    """A range's part of the top: counts of TOP context bytes and the next, sums by (context bytes, path), word totals."""
    _, _, gram, count = _merged(t, _GRAM)
    _, _, _, words = _merged(t, _WORD)
    kinds, keys, values = [np.array([_WORD, _WORD])], [np.array([0, 1])], [np.array([np.count_nonzero(words), words.sum()], np.float64)]
    gram, count = gram[count > 0], count[count > 0]
    for part in _slices(gram):
        g, c = gram[part], count[part]
        tree = Subtree(g, c)
        top = ((g >> np.uint64(8 * (DEPTH + 1 - TOP))) << np.uint64(8) | (g & np.uint64(255))).astype(np.int64)
        for kind, key, value in ((_GRAM, top, c), (_NODE, tree.nodes, tree.weighted)):
            u, at = np.unique(key, return_inverse=True)
            kinds.append(np.full(len(u), kind))
            keys.append(u)
            values.append(np.bincount(at, weights=value))
    return pa.table({"kind": pa.array(np.concatenate(kinds), pa.int32()), "key": pa.array(np.concatenate(keys), pa.int64()), "value": pa.array(np.concatenate(values), pa.float64())})


#: Code lengths travel as whole multiples of 2 ** -20.
_FINE = float(1 << 20)
_VALUE = {_GRAM: np.uint32, _WORD: np.uint64}


def _answerer(shared):
    def answer(t):
        rows, owner, top = [], t.column("range")[0].as_py(), shared()
        for kind in (_GRAM, _WORD):
            blocks, keys, k, c = _merged(t, kind)
            value = np.empty(len(k), _VALUE[kind])
            if kind == _WORD:
                value[:] = c
            for part in _slices(k) if kind == _GRAM else ():
                tree = Subtree(k[part], c[part])
                value[part] = np.rint(-_FINE * top.code(k[part], tree.ones, tree.seen))
            for b, mine in zip(blocks, keys, strict=True):
                rows.append({"block": b, "kind": kind, "range": owner, "values": B.pack(value[B.find(k, mine)[0]])})
        del top, keys, k, c, value
        give_back(collect=False)
        return B.table(rows, [("block", pa.int32()), ("kind", pa.int32()), ("range", pa.int32()), ("values", pa.binary())])

    return answer


_SCORES = "doc_id long, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _finisher(total: int, vocabulary: int, texts_learned: int, ranges: int):
    def finish(docs, answers):
        kinds, owners = (answers.column(c).to_pylist() for c in ("kind", "range"))
        n = docs.num_rows
        found, words = {kind: _Tallies(kind, ranges) for kind in (_GRAM, _WORD)}, []
        for _, _, rows in _few(docs):  # words are few and kept numbered; grams, one a byte, are taken again below
            w = Words([], rows=rows)
            u, at = np.unique(w.hash, return_inverse=True)
            words.append((at.astype(np.int32), u, w.counts))
            found[_WORD].add(u)
            found[_GRAM].add(B.counted(stream(rows)[0])[0])
        del w, u, at
        tables = {}
        for kind, tallies in found.items():
            keys, values = [], []
            # a range's values stand in the order of the block's keys in it
            mine = iter(sorted((owners[i], i) for i, x in enumerate(kinds) if x == kind))
            for r, k, _ in tallies.drain():
                for owner, size in zip(*B.counted(r), strict=True):
                    asked, i = next(mine, (None, None))
                    v = B.unpack(answers.column("values")[i].as_buffer(), _VALUE[kind]) if asked == owner else ()
                    if len(v) != size:
                        raise ValueError(f"{len(v)} answers of range {asked} for {size} keys of a block in range {owner}")
                    values.append(v)
                keys.append(k)
            if next(mine, None):
                raise ValueError("answers to keys that a block does not hold")
            keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            order = np.argsort(keys)
            keys = keys[order]
            values = np.concatenate(values) if values else np.empty(0, _VALUE[kind])
            tables[kind] = keys, values[order]
            del keys, values, order
        log_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
        out = {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_known", "n_bytes")} | {k: np.zeros(n) for k in ("base_score", "score")}
        for (a, b, rows), (at, u, held) in zip(_few(docs), words, strict=True):
            k, v = tables[_WORD]
            c = v[B.find(k, u)[0]].astype(np.float64) if len(u) else np.empty(0)
            owner = np.repeat(np.arange(b - a), held)
            out["n_tokens"][a:b] = held + 1
            out["n_known"][a:b] = np.bincount(owner, weights=(c > 0)[at], minlength=b - a) + (texts_learned > 0)
            out["base_score"][a:b] = np.bincount(owner, weights=log_of(c)[at], minlength=b - a) + log_of(np.float64(texts_learned))
            gram, size = stream(rows)
            both = gram << np.uint64(64 - 8 * (DEPTH + 1)) | np.repeat(np.arange(b - a, dtype=np.uint64), size)
            del gram
            both.sort()
            gram, owner = both >> np.uint64(64 - 8 * (DEPTH + 1)), (both & np.uint64(TOGETHER - 1)).astype(np.min_scalar_type(TOGETHER - 1))
            del both
            start = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1))
            k, v = tables[_GRAM]
            code = np.repeat(v[B.find(k, gram[start])[0]], np.diff(start, append=len(gram)))
            out["n_bytes"][a:b], out["score"][a:b] = size, np.bincount(owner, weights=code, minlength=b - a) / -_FINE
            del gram, owner, start, code
        del rows, words, tables, found, k, v
        give_back(collect=False)
        return pa.table({"doc_id": pa.array(docs.column("doc_id").to_pylist(), pa.int64()), **{k: pa.array(x) for k, x in out.items()}})

    return finish


def score(documents: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, n_bytes, train_tokens, base_score and score of each document; it learns from the rows where learn holds."""
    spark = documents.sparkSession
    learned = F.coalesce(learn, F.lit(False))
    docs, _, ranges = B.in_blocks(documents.withColumn("learn", learned), ["doc_id", "text", "learn"])
    texts_learned = documents.where(learned).count()
    sent = materialise(docs.groupBy("block").applyInArrow(_sender(ranges), B.ENTRY), "lm-counts")
    parts = sent.groupBy("range").applyInArrow(_top_parts, "kind int, key long, value double")
    sums = parts.groupBy("kind", "key").agg(F.sum("value").alias("value")).toArrow()  # bounded, see above
    kind, key, value = (sums.column(c).to_numpy() for c in ("kind", "key", "value"))
    of = lambda k: (key[kind == k], value[kind == k])
    stats = dict(zip(*of(_WORD), strict=True))
    vocabulary, total = int(stats.get(0, 0)) + (texts_learned > 0), int(stats.get(1, 0)) + texts_learned
    top = share(spark, Top(*of(_GRAM), *of(_NODE)))
    answers = sent.groupBy("range").applyInArrow(_answerer(top), "block int, kind int, range int, values binary")
    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finisher(total, vocabulary, texts_learned, ranges), _SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


ship(__name__)
