"""Operator 4, document fingerprints by consistent weighted sampling.

Built of SQL functions only. A document is a bag of lower-cased words weighted by their counts. As
weights are whole numbers, the i-th occurrence of a word is an element (word, i) of its own, and a
document that has a word n times holds (word, 1) to (word, n). Each of K samples gives every element a
random place by hashing, the same in all documents, and takes the element with the least. Two documents
agree in a sample with probability sum of min / sum of max of their weights, the generalised Jaccard
similarity; samples are independent, so a pair's likeness, the share that agree, follows the binomial
law. Pairs that share frequent words err together. Signatures hold 32 bits of each sample.

A hash of 64 bits serves two samples: for one its high half is the place and its low half the name, for
the other the reverse. Each element is one row, and the K minima by document, in generated code, give the
signature. The rows of a document stay in one partition from the join with its successor on.

Defined cases: null text counts as empty; a document without words has the fingerprint of K zero
samples, alike to its own kind (1.0) and to no other; rows are ordered by (doc_id, hash of text), nulls
first; repeated (doc_id, text) rows are one document in that order, returned as often as they occur; a
single document is its own successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm._store import materialise
from wavegrid.llm.words import WORD, lower_ascii
from wavegrid.operators.ordering import range_of

SAMPLES = 32
#: Ranges of doc_id in which rows are ordered; the tables of range bounds and first rows are bounded by it.
RANGES = 1024
#: Copies of one row that are expanded at once.
PIECE = 1 << 12
_KEYS = ["__id", "__none", "__hash"]
_NEXT = ["__nid", "__nnone", "__nhash"]


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, signature (array of K longs) of the column text; keys must be unique."""
    words = texts.select(*keys, F.explode_outer(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), 0)).alias("__w"))
    words = words.select(*keys, F.when(F.col("__w").isNotNull(), F.xxhash64("__w")).alias("__w"))
    weighted = words.groupBy(*keys, "__w").agg(F.count("__w").alias("__n"))  # 0 in the row of no words
    elements = weighted.select(*keys, "__w", "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("__n", F.lit(1)))).alias("__i"))
    elements = elements.select(*keys, "__n", F.xxhash64("__w", "__i").alias("__e"))
    draws = [F.xxhash64(F.col("__e").bitwiseXOR(F.lit(j).cast("long"))).alias(f"__g{j}") for j in range((samples + 1) // 2)]
    drawn = elements.select(*keys, "__n", *draws)  # a step of its own: each hash is made once and read twice
    least = [F.min(_turned(F.col(f"__g{k // 2}")) if k % 2 else F.col(f"__g{k // 2}")).alias(f"__s{k}") for k in range(samples)]
    whole = F.array(*[F.when(F.col("__n") > 0, F.col(f"__s{k}").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(0) for k in range(samples)])
    return drawn.groupBy(*keys).agg(F.max("__n").alias("__n"), *least).select(*keys, whole.alias("signature"))


def _turned(h: Column) -> Column:
    """The halves of a long, exchanged."""
    return F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def successors(keys: DataFrame) -> DataFrame:
    """Distinct _KEYS with n_chars, copies and the _NEXT of each in ascending (doc_id, hash) order, the last's being the first.

    Rows are ordered within ranges of doc_id; the first row of each range, a bounded table, continues the one before.
    """
    rows = keys.groupBy(*_KEYS, "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    n = rows.count()
    cuts = min(RANGES, max(1, n // 4096))
    bounds = keys.where("not __none").select(F.percentile_approx("__id", [i / cuts for i in range(1, cuts)] or [0.5], 10000).alias("b")).first()["b"] or []
    at = range_of(F.col("__id"), sorted(set(bounds)))
    no_id = F.floor(F.col("__hash") / F.lit(2.0**64) * cuts).cast("int") - 2 * cuts  # rows without doc_id come first, by hash
    ranged = rows.withColumn("__range", F.when(F.col("__none"), no_id).otherwise(at))
    me = F.struct(F.col("__none").alias("__nnone"), F.col("__id").alias("__nid"), F.col("__hash").alias("__nhash"))
    order = Window.partitionBy("__range").orderBy("__id", "__hash")
    firsts = ranged.groupBy("__range").agg(F.min(me).alias("first"))
    line = Window.orderBy("__range")  # at most 3 * RANGES rows
    after = firsts.select("__range", F.coalesce(F.lead("first").over(line), F.first("first").over(line)).alias("after"))
    out = ranged.withColumn("next", F.lead(me).over(order)).join(F.broadcast(after), "__range")
    return out.select(*_KEYS, "n_chars", "copies", F.coalesce("next", "after").alias("next")).select(*_KEYS, "n_chars", "copies", "next.*")


def fingerprint(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    The edited text has its last half replaced by as much from the start of the next document's text.
    Only that much of the next text travels to it.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"), F.col("doc_id").isNull().alias("__none"), F.xxhash64(text).alias("__hash"), text.alias("text")
    )
    links = materialise(successors(keyed.select(*_KEYS, F.length("text").cast("long").alias("n_chars"))), "links")
    dealt = keyed.repartition(*_KEYS).dropDuplicates(_KEYS)
    wanted = links.select(F.col("__id").alias("__pid"), F.col("__none").alias("__pnone"), F.col("__hash").alias("__phash"), F.call_function("div", F.col("n_chars"), F.lit(2)).alias("half"), *[F.col(c).alias(k) for c, k in zip(_NEXT, _KEYS, strict=True)])
    start = F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("start")
    starts = dealt.join(wanted, _KEYS).select(F.col("__pid").alias("__id"), F.col("__pnone").alias("__none"), F.col("__phash").alias("__hash"), "half", start)
    own = F.substring(F.col("text"), F.lit(1), (F.length("text") - F.col("half")).cast("int"))
    pairs = dealt.join(starts, _KEYS).select(*_KEYS, "text", F.concat(own, "start").alias("edited"))
    digests = pairs.select(*_KEYS, F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    both = pairs.select(*_KEYS, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    signed = signatures(both.select(*_KEYS, "v.which", "v.text"), [*_KEYS, "which"], samples)
    of = lambda w: F.first(F.when(F.col("which") == w, F.col("signature")), ignorenulls=True)
    signed = signed.groupBy(*_KEYS).agg(of(0).alias("mine"), of(1).alias("edit"))
    made = materialise(signed.join(digests, _KEYS), "signatures")
    following = made.select(*[F.col(k).alias(c) for k, c in zip(_KEYS, _NEXT, strict=True)], F.col("mine").alias("theirs"))
    rows = links.join(made, _KEYS).join(following, _NEXT)
    return rows.select(
        F.when(~F.col("__none"), F.col("__id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        as_text(F.col("mine")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("edit")).alias("near_edited"), likeness(F.col("mine"), F.col("theirs")).alias("near_next"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long"))).alias("__piece"), "copies",
    ).withColumn("__copy", F.explode(F.sequence("__piece", F.least(F.col("__piece") + PIECE, F.col("copies")) - 1))).drop("__piece", "__copy", "copies")
