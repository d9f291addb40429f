"""Operator 8, n-gram Jaccard join: a size-aware heavy-light self join of word-shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles; equal sets are one from then on. Two
sets link when 100 * intersection >= threshold * union. Sets are split by size:

* light sets list, for every overlap c that a partner of theirs may need, all their subsets of c
  shingles; a common subset of c shingles proves the link;
* heavy sets keep inverted lists of the rarest shingles only: two sets that link share one of the
  first size - ceil(threshold * size) + 1 in the order of (document frequency, hash).

Sets that share a subset or such a shingle form a candidate group, and inside a group inverted lists are
scanned to count the exact overlap of every pair. That gives edges that connect what is linked, and each
set's number of links, weighted by copies.

The boundary is the size at which both methods together send the fewest entries, by a histogram of text
sizes counted over the whole table. Document frequencies are counted over all documents by the dictionary
join of ``_blocks``; shingles of one document only, the bulk, never leave their block again. (A block
clips its counts at 255 and a range at 65,535: the order of prefixes is any total order, the same
everywhere, so that changes the length of some lists, never a result.)

A candidate group of over GROUP sets is never in one task: its sets are dealt by size class, in which
linked sets are alike or neighbours, and chunks of GROUP; a task compares two chunks. A chunk's rows
travel once for each chunk of its own and the neighbouring classes.

Defined cases: null, empty or blank text has an empty set, links with nothing and is its own component;
fewer words than the width make one shingle; repeated rows and equal texts share a component and count
each other as links; null doc_ids are not eligible as a component's smallest id (a component of them
alone has none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.llm import _blocks as B
from wavegrid.llm._graph import components
from wavegrid.llm._store import give_back, lean, materialise, ship
from wavegrid.llm._text import mix64, text_sets
from wavegrid.llm.words import GAP, spare

#: Largest number of distinct sets that one task compares.
GROUP = 1000
#: Rows that get their set key at once; bounds the Python copies of an Arrow batch and the batches that go back.
ROWS = 512


def least_overlap(a: int, b: int, threshold: int) -> int:
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(size: int, threshold: int) -> int:
    return size - -(-threshold * size // 100) + 1


def _overlaps(size: int, threshold: int) -> list[int]:
    """Every overlap that a partner of a set of this size may need."""
    return sorted({least_overlap(size, b, threshold) for b in range(-(-threshold * size // 100), 100 * size // threshold + 1)} & set(range(1, size + 1)))


def _signatures(size: int, threshold: int) -> int:
    """Entries of a light set: its subsets."""
    return sum(math.comb(size, c) for c in _overlaps(size, threshold))


def _entries(size: int, threshold: int) -> int:
    """Entries of a heavy set: its shingles, the answers to them and its inverted lists."""
    return 2 * size + prefix_length(size, threshold)


def largest_light(threshold: int) -> int:
    """No set beyond this size is light: its subsets cost over four times the inverted lists."""
    size = 0
    while _signatures(size + 1, threshold) <= 4 * _entries(size + 1, threshold):
        size += 1
    return size


def light_boundary(threshold: int, sets: dict[int, int]) -> int:
    """Size up to which sets are light, so that the fewest entries are sent; sets: how many there are of each size.

    Light sets that a heavy set may link with stand in inverted lists as well, which is what a higher boundary saves.
    """

    def cost(light: int) -> int:
        seam = -(-threshold * (light + 1) // 100)
        total = 0
        for s, n in sets.items():
            if 0 < s <= light:
                total += n * (_signatures(s, threshold) + (_entries(s, threshold) if s >= seam else 0))
            elif s > light:
                total += n * _entries(s, threshold)
        return total

    return min(range(largest_light(threshold) + 1), key=lambda b: (cost(b), b))


def _set_key(s: np.ndarray) -> int:
    """64 bits of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix64(np.bitwise_xor.reduce(mix64(s)) + np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))) * np.uint64(3) + np.uint64(len(s)) + np.zeros(1, np.uint64))[0])


def _subsets(s: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """(c, signature) of every subset of a light set that may prove a link."""
    out = []
    for c in _overlaps(len(s), threshold):
        rows = np.array(list(combinations(range(len(s)), c)))
        h = np.zeros(len(rows), np.uint64)
        for j in range(c):
            h = (h + s[rows[:, j]]) * np.uint64(0xD1342543DE82EF95)
        out += [(c, int(x)) for x in mix64(h + np.uint64(c)).astype(np.int64)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sender(width: int, ranges: int):
    def send(key, t):
        seen: set[int] = set()
        keys, counts = [], []
        waiting, held = [], 0
        for _, s in text_sets(B.texts_of(t), width):
            k = _set_key(s)
            if k not in seen:
                seen.add(k)
                waiting.append(s)
                held += len(s)
                if held > 1 << 20:
                    u, c = np.unique(np.concatenate(waiting), return_counts=True)
                    keys.append(u), counts.append(c)
                    waiting, held = [], 0
        if waiting:
            u, c = np.unique(np.concatenate(waiting), return_counts=True)
            keys.append(u), counts.append(c)
        u, c = B.summed(keys, counts)
        rows = B.entries(key[0].as_py(), 0, B.range_of(u, ranges), u, np.minimum(c, 255).astype(np.uint8))
        return B.table(rows, B.ENTRY_FIELDS)

    return send


def _answer(key, t):
    """Document frequency, up to 65535, of every key that two documents hold at least."""
    blocks = t.column("block").to_pylist()
    keys = [B.unpack_keys(x) for x in t.column("keys").to_pylist()]
    counts = [B.unpack(x, np.uint8) for x in t.column("counts").to_pylist()]
    k, c = B.summed(keys, counts)
    k, c = k[c > 1], np.minimum(c[c > 1], 65535).astype(np.uint16)
    rows = []
    for b, mine in zip(blocks, keys, strict=True):
        at, there = B.find(k, mine)
        if there.any():
            rows.append({"block": b, "keys": B.pack_keys(mine[there]), "values": B.pack(c[at[there]])})
    return B.table(rows, [("block", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


_SETS = "doc_id long, set_key long, n_shingles int, shared binary, prefix array<long>, subsets array<struct<c:int,signature:long>>"


def _finisher(width: int, threshold: int, light: int):
    inverted_from = -(-threshold * (light + 1) // 100)

    def finish(docs, answers):
        keys = [B.unpack_keys(x) for x in answers.column("keys").to_pylist()]
        values = [B.unpack(x, np.uint16) for x in answers.column("values").to_pylist()]
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        v = np.concatenate(values) if values else np.empty(0, np.uint16)
        order = np.argsort(k)
        k, v = k[order], v[order]
        ids = docs.column("doc_id").to_pylist()
        n = len(ids)
        set_key, size, shared, prefix, subsets = [None] * n, [0] * n, [None] * n, [None] * n, [None] * n
        for i, s in text_sets(B.texts_of(docs), width):
            set_key[i], size[i] = _signed(_set_key(s)), len(s)
            if len(s) <= light:
                subsets[i] = [{"c": c, "signature": x} for c, x in _subsets(s, threshold)]
            at, there = B.find(k, s)
            mine = s[there]
            if len(s) <= light and len(mine):
                shared[i] = mine.tobytes()
            room = prefix_length(len(s), threshold) - int(np.count_nonzero(~there))
            if len(s) >= inverted_from and room > 0:
                prefix[i] = mine[np.lexsort((mine, v[at[there]]))[:room]].astype(np.int64).tolist()
                shared[i] = mine.tobytes()
        kind = pa.list_(pa.struct([("c", pa.int32()), ("signature", pa.int64())]))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "set_key": pa.array(set_key, pa.int64()), "n_shingles": pa.array(size, pa.int32()),
                "shared": pa.array(shared, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "subsets": pa.array(subsets, kind),
            }
        )

    return finish


def _compare(threshold: int):
    """Links of the sets of one group, or of those across two of its chunks: edges that connect the linked, and numbers of links.

    A row (u, v, null) is an edge, a row (u, null, n) says that u links with n documents of other sets here.
    """

    def compare(key, t):
        across = key[1].as_py() != key[2].as_py()
        column = lambda c: t.column(c).to_numpy()
        order = np.lexsort((column("set_key"), column("n_shingles")))
        node, size, chunk, copies = (column(c).astype(np.int64)[order] for c in ("set_key", "n_shingles", "chunk", "copies"))
        blobs = t.column("shared").to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        m = len(sets)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        lists, starts = owner[np.argsort(dense, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(dense))))
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        label, links = np.arange(m), np.zeros(m, np.int64)  # the component so far; documents linked with
        edges: list[tuple[int, int]] = []
        first = np.searchsorted(100 * size, threshold * size)  # smaller sets cannot link
        for i in range(m):
            mine = dense[at[i] : at[i + 1]]
            found = np.bincount(np.concatenate([lists[starts[x] : starts[x + 1]] for x in mine]), minlength=m)[first[i] : i]
            ok = found * (100 + threshold) >= threshold * (size[first[i] : i] + size[i])
            if across:
                ok &= chunk[first[i] : i] != chunk[i]
            js = np.flatnonzero(ok) + first[i]
            if not len(js):
                continue
            links[i] += copies[js].sum()
            links[js] += copies[i]
            others, one_of = np.unique(label[js], return_index=True)
            edges += [(int(node[i]), int(node[js[x]])) for x in one_of]
            label[np.isin(label[:i], others).nonzero()[0]] = i
        some = np.flatnonzero(links)
        u = np.concatenate(([e[0] for e in edges], node[some])).astype(np.int64)
        nothing = [None] * len(edges)
        return pa.table(
            {
                "u": pa.array(u), "v": pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()),
                "n": pa.array(nothing + links[some].tolist(), pa.int64()),
            }
        )

    return compare


def _stars(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of an inverted list with the list's smallest (n_shingles, set_key)."""
    hub = lists.groupBy(*keys).agg(F.min(F.struct("n_shingles", "set_key")).alias("hub"), F.count(F.lit(1)).alias("length"))
    return lists.join(hub.where("length > 1"), keys).where("set_key <> hub.set_key")


def _sizes(documents: DataFrame, width: int, threshold: int) -> tuple[int, dict[int, int]]:
    """(bytes of all texts, number of texts of each size that could be light).

    An estimate that only the boundary rests on: a text's size is that of its set but for repeated
    shingles, and a text of over a kilobyte counts as the largest without a look at its words.
    """
    most = largest_light(threshold) + width
    words = F.when(F.octet_length("text") < 1024, F.size(F.filter(F.split("text", GAP), lambda w: w != ""))).otherwise(most)
    size = F.when(words > 0, F.greatest(F.lit(1), F.least(words, F.lit(most)) - (width - 1))).otherwise(0)
    rows = documents.where("text is not null").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # most rows
    return sum(r["bytes"] for r in rows), {r["size"]: r["n"] for r in rows}


def _chunked(members: DataFrame, threshold: int) -> DataFrame:
    """members once for each pair (a, b) of chunks of their group in which they are compared."""
    total = Window.partitionBy("grp")
    ratio = math.log(100 / threshold)
    # linked sets are in the same size class or in neighbouring ones
    by_class = members.groupBy("grp", F.floor(F.log("n_shingles") / ratio).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("m"))
    by_class = by_class.withColumn("all", F.sum("m").over(total))  # a few dozen classes a group
    plan = by_class.groupBy("grp").agg(F.first("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("m") / GROUP).alias("chunks")))).alias("chunks"))
    rows = members.join(plan, "grp")
    whole = F.col("all") <= GROUP
    mine = F.when(whole, F.lit(0)).otherwise(F.floor(F.log("n_shingles") / ratio)).cast("long")
    cell = lambda k, i: F.shiftleft(k, 32) + i
    chunk = F.when(whole, F.lit(0)).otherwise(cell(mine, F.pmod(F.xxhash64("set_key"), F.col("chunks")[mine])))
    near = F.flatten(
        F.transform(
            F.filter(F.array(mine - 1, mine, mine + 1), lambda k: F.map_contains_key("chunks", k)),
            lambda k: F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks")[k] - 1), lambda i: cell(k, i)),
        )
    )
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(near)))
    return rows.select("grp", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "set_key", "n_shingles", "copies", "shared", "chunk")


def _linked(documents: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_key, n_shingles of each document; set_key, root, n_links of each distinct set that is not empty)."""
    size, histogram = _sizes(documents, width, threshold)
    light = light_boundary(threshold, histogram)
    docs, _, ranges = B.in_blocks(documents, ["doc_id", "text"], size)
    sent = docs.groupBy("block").applyInArrow(lean(_sender(width, ranges)), B.ENTRY)
    answers = sent.groupBy("range").applyInArrow(lean(_answer), "block int, keys binary, values binary")
    finished = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(_finisher(width, threshold, light)), _SETS)
    sets = materialise(finished, "sets")

    proven = sets.where("subsets is not null").select("set_key", "n_shingles", F.explode("subsets").alias("s")).select("set_key", "n_shingles", "s.*").distinct()
    light_edges = _stars(proven, ["c", "signature"]).where(F.col("c") * (100 + threshold) >= threshold * (F.col("n_shingles") + F.col("hub.n_shingles")))
    lists = sets.where("prefix is not null").select("set_key", "n_shingles", F.explode("prefix").alias("shingle")).distinct()
    stars = [x.select(F.col("hub.set_key").alias("u"), F.col("set_key").alias("v")) for x in (light_edges, _stars(lists, ["shingle"]))]
    candidates = components(stars[0].unionByName(stars[1]))
    members = sets.where("shared is not null").groupBy("set_key", "n_shingles").agg(F.first("shared").alias("shared"), F.count(F.lit(1)).alias("copies"))
    members = members.join(candidates.select(F.col("node").alias("set_key"), F.col("root").alias("grp")), "set_key")
    found = materialise(_chunked(members, threshold).groupBy("grp", "a", "b").applyInArrow(lean(_compare(threshold)), "u long, v long, n long"), "links")

    roots = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("set_key"), "root")
    links = found.where("n is not null").groupBy(F.col("u").alias("set_key")).agg(F.sum("n").alias("others"))
    keyed = sets.select("doc_id", "set_key", "n_shingles")
    classes = keyed.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("least"))
    classes = classes.join(roots, "set_key", "left").join(links, "set_key", "left")
    return keyed, classes.select("set_key", F.coalesce("root", "set_key").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "least")


def join_components(documents: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and n_links (documents linked with) of each document."""
    keyed, classes = _linked(documents, width, threshold)
    smallest = classes.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = classes.join(smallest, "root").select("set_key", "component_id", "n_links")
    size = F.col("n_shingles").cast("long")
    linked = keyed.join(named, "set_key").select("doc_id", size, "component_id", "n_links")
    alone = keyed.where("set_key is null").select("doc_id", size, F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def _with_set_key(documents: DataFrame, width: int, name: str) -> DataFrame:
    """documents with the set's key in a column of that name; null where the set is empty."""
    text = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = [None] * part.num_rows
                for i, s in text_sets([x and x.encode() for x in part.column(text).to_pylist()], width):
                    keys[i] = _signed(_set_key(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=[*part.schema.names, name])
        give_back()

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(documents: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the smallest (doc_id, set key), null doc_ids last.

    Of rows with an empty set, one stays for each doc_id, and all without doc_id stay.
    """
    keyed, classes = _linked(documents, width, threshold)
    empty = keyed.where("set_key is null")
    best = classes.groupBy("root").agg(F.min(F.struct("least.unnamed", "least.doc_id", "set_key")).alias("best"))
    unnamed, known, blank, own = spare(documents.columns, "unnamed", "known", "blank", "own")
    kept = best.select("best.doc_id", F.col("best.set_key").alias(own)).unionByName(empty.where("doc_id is not null").select("doc_id", F.col("set_key").alias(own)))
    keys = {unnamed: F.col("doc_id").isNull(), known: F.coalesce("doc_id", F.lit(0)), blank: F.col(own).isNull(), own: F.coalesce(own, F.lit(0))}
    # keys without nulls, so that the join deals the rows as dropDuplicates needs them
    one = _with_set_key(documents, width, own).withColumns(keys).join(kept.withColumns(keys).select(*keys), [*keys], "left_semi").dropDuplicates([*keys])
    bare = documents.where(F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return one.select(*[F.col(f"`{c}`") for c in documents.columns]).unionByName(bare)


ship(__name__)
