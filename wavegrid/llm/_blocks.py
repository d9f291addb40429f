"""A dictionary join for corpus statistics: blocks of documents look up values of the keys they hold.

Documents are dealt into blocks by a hash of doc_id. A block sends each of its distinct keys once, with
a count, to the range that owns the key; the range adds up the counts of all blocks and answers each
block with the values it asked for; the block's documents meet the answers. A key that every document
holds costs one entry a block, so no key is hot, and no table of all keys is ever broadcast or
collected. Keys travel as sorted, differenced byte planes in binary columns. A block sends a range one
row, and none if it holds no key of it, so the rows are never more than the distinct keys of the blocks,
which grow with the input; before that, blocks times ranges bounds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm._store import partitions, ship

#: Bytes of text in a block, about.
BLOCK_BYTES = 16 << 20
ENTRY = "range int, block int, kind int, keys binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array: the high planes of small numbers compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def in_blocks(documents: DataFrame, columns: list[str], size: int | None = None) -> tuple[DataFrame, int, int]:
    """Documents with a column block, the number of blocks and of key ranges; size: bytes of all texts, if known."""
    spark = documents.sparkSession
    if size is None:
        size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    return documents.select(block.alias("block"), *columns), blocks, 2 * blocks


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of uint64 keys, in order."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def entries(block: int, kind: int, ranges: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """One row for each range that owns some of the keys; ranges, then keys, must ascend."""
    if not len(keys):
        return []
    cut = np.flatnonzero(np.diff(ranges)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    return [
        {"range": int(ranges[a]), "block": block, "kind": kind, "keys": pack_keys(keys[a:b]), "counts": pack(counts[a:b])}
        for a, b in zip(starts, stops, strict=True)
    ]


def table(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], type=t) for n, t in fields})


ENTRY_FIELDS = [("range", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    x = np.sort(x)
    if not len(x):
        return x, np.empty(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    return x[start], np.diff(start, append=len(x))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts; each array of keys ascends, without repeats."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0].astype(np.int64)
    k, _ = counted(np.concatenate(keys))
    c = np.zeros(len(k), np.int64)
    for mine, n in zip(keys, counts, strict=True):
        c[np.searchsorted(k, mine)] += n.astype(np.int64)
    return k, c


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


class Tally:
    """Distinct keys and sums of their counts, gathered bit by bit; merged when as many keys wait as are merged, and MERGE at least."""

    MERGE = 1 << 16

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """keys ascend, without repeats; all calls give counts, or none does."""
        self.keys.append(keys.copy())  # a slice would hold the whole array
        if counts is not None:
            self.counts.append(narrow(counts))
        self.waiting += len(keys)
        if self.waiting > max(self.MERGE, self.merged):
            k, c = self.total()
            self.keys, self.counts, self.waiting, self.merged = [k], [] if c is None else [narrow(c)], 0, len(k)

    def total(self) -> tuple[np.ndarray, np.ndarray | None]:
        if self.keys and not self.counts:
            return counted(np.concatenate(self.keys))[0], None
        return summed(self.keys, self.counts)


def texts_of(t: pa.Table | pa.RecordBatch) -> list[bytes | None]:
    return t.column("text").cast(pa.binary()).to_pylist()


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, whether it is there) of each wanted key; keys ascend."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


ship(__name__)
