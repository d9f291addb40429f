"""Operator 7, best-fit packing under conflicts.

Documents, measured in words, go into bins of a fixed capacity. Open bins stand in the order of what
they have left and carry a bitmap of the sources and duplicate clusters in them; a document conflicts
with a bin that holds its source or its cluster. From the first bin that is large enough the successor
search goes on, bin by bin, until the tightest compatible one is found; else a bin is opened.

Only (doc_id, size, source, cluster) is shuffled, never text. Rows are numbered without a window over
all rows and dealt into groups of about GROUP by number, so that equal rows, a hot source or a hot
cluster spread evenly; each group is packed in one task.

Defined cases: null or blank text has size 0 and gets no bin (bin_id null); a text longer than a bin
fills whole bins with its first pieces and packs the rest; null source is a source of its own; equal
rows are interchangeable; a null doc_id is a row like others; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm._store import materialise, ship
from wavegrid.llm.sharding import number_rows
from wavegrid.llm.words import count_words

CAPACITY = 2048
GROUP = 20_000
_STEP = 512


def best_fit(size: np.ndarray, bits: np.ndarray, width: int, capacity: int) -> np.ndarray:
    """Bin of each item, for items in descending size. bits: the numbers of each item's bits (n x k), width of the bitmaps."""
    n = len(size)
    where = np.zeros(n, np.int64)
    bitmap = np.zeros((max(n, 1), -(-width // 64)), np.uint64)
    word, mask = bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64)
    left = np.empty(n, np.int64)  # of open bins, ascending
    name = np.empty(n, np.int64)
    open_bins = made = 0
    least = size[-1] if n else 0
    for i in range(n):
        s, w, m = size[i], word[i], mask[i]
        at = int(np.searchsorted(left[:open_bins], s))
        found = -1
        while at < open_bins:
            ids = name[at : min(at + _STEP, open_bins)]
            free = ((bitmap[ids[:, None], w] & m) == 0).all(axis=1)
            k = int(free.argmax())
            if free[k]:
                found = at + k
                break
            at += _STEP
        if found < 0:
            b, rest = made, capacity - s
            made += 1
        else:
            b, rest = name[found], left[found] - s
            left[found : open_bins - 1] = left[found + 1 : open_bins]
            name[found : open_bins - 1] = name[found + 1 : open_bins]
            open_bins -= 1
        where[i] = b
        np.bitwise_or.at(bitmap[b], w, m)
        if rest >= least:
            to = int(np.searchsorted(left[:open_bins], rest))
            left[to + 1 : open_bins + 1] = left[to:open_bins].copy()
            name[to + 1 : open_bins + 1] = name[to:open_bins].copy()
            left[to], name[to] = rest, b
            open_bins += 1
    return where


def _codes(values: list) -> tuple[np.ndarray, int]:
    seen: dict = {}
    return np.array([seen.setdefault(v, len(seen)) for v in values], np.int64), len(seen)


def pack_group(rows: list[tuple], capacity: int) -> list[dict]:
    """Pieces with their bin, for rows of (row_number, doc_id, size, source, cluster)."""
    pieces, out = [], []
    bins = 0
    for row, doc_id, size, source, cluster in rows:
        whole, rest = divmod(size, capacity)
        for p in range(whole):
            out.append({"bin": bins, "row_number": row, "doc_id": doc_id, "piece": p, "start": p * capacity, "words": capacity})
            bins += 1
        if rest:
            pieces.append((rest, row, doc_id, whole, source, cluster))
        elif not whole:
            out.append({"bin": None, "row_number": row, "doc_id": doc_id, "piece": 0, "start": 0, "words": 0})
    pieces.sort(key=lambda x: (-x[0], x[1]))
    source, n_sources = _codes([p[4] for p in pieces])
    cluster, n_clusters = _codes([p[5] for p in pieces])
    where = best_fit(np.array([p[0] for p in pieces], np.int64), np.stack((source, n_sources + cluster), axis=1), n_sources + n_clusters, capacity) if pieces else []
    for (rest, row, doc_id, whole, *_), b in zip(pieces, where, strict=True):
        out.append({"bin": bins + int(b), "row_number": row, "doc_id": doc_id, "piece": whole, "start": whole * capacity, "words": rest})
    return out


_PLAN = "bin_id long, place int, doc_id long, row_number long, piece int, start long, words int, source string"


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None) -> DataFrame:
    """bin_id, place in the bin, doc_id, row_number, piece, start and words (of the text) and source of every piece.

    cluster: a number of the document's duplicate cluster, as the components of a near-duplicate join; without it equal texts are a cluster.
    """
    spark = docs.sparkSession
    cluster = F.xxhash64("text") if cluster is None else cluster.cast("long")
    keys = docs.select("doc_id", count_words(F.col("text")).alias("size"), "source", cluster.alias("cluster"))
    keys = materialise(keys, "sizes")  # texts are read once
    n = keys.count()
    if n == 0:
        return spark.createDataFrame([], _PLAN)
    groups = -(-n // GROUP)

    def run(key, t):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("row_number", "doc_id", "size", "source", "cluster")), strict=True))
        found = pack_group(rows, capacity)
        source = {r[0]: r[3] for r in rows}
        found.sort(key=lambda x: (x["bin"] is None, x["bin"] or 0, -x["words"], x["row_number"]))
        base = key[0].as_py() << 32
        place, last = 0, object()
        for x in found:
            place = place + 1 if x["bin"] == last else 0
            last = x["bin"]
            x |= {"bin_id": None if x["bin"] is None else base + x["bin"], "place": None if x["bin"] is None else place, "source": source[x["row_number"]]}
        kinds = {"bin_id": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "row_number": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "words": pa.int32(), "source": pa.string()}
        return pa.table({c: pa.array([x[c] for x in found], k) for c, k in kinds.items()})

    numbered = number_rows(keys, ["doc_id", "size", "source", "cluster"])
    grouped = numbered.withColumn("grp", (F.col("row_number") % groups).cast("int"))
    return grouped.groupBy("grp").applyInArrow(run, _PLAN)


ship(__name__)
