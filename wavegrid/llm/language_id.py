"""Operator 10, language ID: error-correcting output codes over n-gram classifiers.

Each language has a codeword; one binary classifier per bit tells the languages with a 1 from those
with a 0. The classifiers are naive Bayes over hashed byte 2- and 3-grams of lower-cased text, trained
on the n-gram counts of all labelled documents: the counts of one language are one row of fixed size,
summed in parallel, slice by slice, so the model's size depends on the number of languages only. A text's bit margins
are the mean log odds per n-gram; loss-weighted decoding takes the codeword with the least exponential
loss. The prediction is ambiguous when the two nearest codewords are less than ``margin`` apart.

Defined cases: null text or text without a letter: ``und``, score 0; no training rows: ``und`` for all;
one language only: that one, score 1; null lang is not learned from; a null doc_id counts as the empty
text in ``fold``; repeated rows are judged alike and each is learned from; an empty table gives an empty
result; extra columns are ignored by ``classify`` and kept by ``keep_clear``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm._store import drop, give_back, materialise, share, ship
from wavegrid.llm._text import chunks

#: Features: all byte pairs, then byte triples by hash.
PAIRS, TRIPLES = 1 << 16, 1 << 16
#: Brings the mean log odds per n-gram of clean text to about one or two.
SCALE = 0.5
#: Rows that are judged at once; bounds the Python copies of an Arrow batch.
ROWS = 2048
#: A language's counts travel in so many rows of PART features, and meet bucket by bucket of tasks first.
SLICES, BUCKETS = 16, 1024
PART = (PAIRS + TRIPLES) // SLICES

_NAMES = np.arange(256, dtype=np.uint8)
_NAMES[65:91] += 32
for _b in range(128):
    if not chr(_b).isalpha():
        _NAMES[_b] = 32
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of every n-gram, start of each text's n-grams, their number), for one chunk of texts."""
    rows = [b" " + x + b" " for x in texts]
    buf = _NAMES[np.frombuffer(b"".join(rows), np.uint8)].astype(np.uint32)
    length = np.array([len(r) for r in rows])
    end = np.cumsum(length)
    inner = np.ones(len(buf), bool)
    inner[end - 1] = False
    blank = buf == 32
    nxt = np.append(buf[1:], np.uint32(32))
    inner &= ~(blank & (nxt == 32))
    pair = (buf << np.uint32(8)) | nxt
    triple = ((((pair << np.uint32(8)) | np.append(nxt[1:], np.uint32(32))) * np.uint32(2654435761)) >> np.uint32(16)) + np.uint32(PAIRS)
    owner = np.repeat(np.arange(len(rows)), length)[inner]
    count = np.bincount(owner, minlength=len(rows))
    start = np.cumsum(count) - count
    return np.stack((pair[inner], triple[inner]), axis=1), start, count


def codewords(n: int, seed: int = 10) -> np.ndarray:
    """n codewords of -1 and 1: all splits of up to 5 languages, else the best of some seeded random codes."""
    if n <= 5:
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 1 << (n - 1))] for i in range(n)]).reshape(n, -1)
    bits = 8 + 4 * int(np.ceil(np.log2(n)))
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, float32


def _add(t: pa.Table) -> pa.Table:
    """One row with the sums of all rows of a language and slice."""
    total = np.zeros(PART)
    for x in t.column("sums").to_pylist():
        total += np.frombuffer(x)
    return pa.table({"lang": [t.column("lang")[0].as_py()], "slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary()), "total": [float(total.sum())]})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams per language over all rows; a document weighs the same whatever its length.

    A task's counts of a language travel in SLICES rows, which meet in two steps: those of a bucket of
    tasks, then the buckets. The weights of a slice's features are made where its counts are, so that
    the driver gets the model alone.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                f, start, n = features([x or b"" for x in texts[a:b]])
                per = np.repeat(1.0 / np.maximum(n, 1), n)
                owner = np.repeat(np.arange(b - a), n)
                for name in set(langs[a:b]):
                    mine = np.array([x == name for x in langs[a:b]])[owner]
                    own = sums.setdefault(name, np.zeros(PAIRS + TRIPLES))
                    for j in (0, 1):
                        own += np.bincount(f[mine, j], weights=per[mine], minlength=PAIRS + TRIPLES)
        for name, x in sums.items():
            parts = [p.tobytes() for p in x.reshape(SLICES, PART)]
            yield pa.RecordBatch.from_pydict({"lang": [name] * SLICES, "slice": pa.array(range(SLICES), pa.int32()), "sums": pa.array(parts, pa.binary()), "total": x.reshape(SLICES, PART).sum(axis=1)})
        give_back()

    kind = "lang string, slice int, sums binary, total double"
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = rows.mapInArrow(count, kind).withColumn("bucket", F.spark_partition_id() % BUCKETS)
    sums = counted.groupBy("lang", "slice", "bucket").applyInArrow(_add, kind).groupBy("lang", "slice").applyInArrow(_add, kind)
    sums = materialise(sums, "language-sums")
    totals = {r["lang"]: r["total"] for r in sums.groupBy("lang").agg(F.sum("total").alias("total")).collect()}  # a number for each language
    names = sorted(totals)
    code = codewords(len(names)) if names else np.zeros((0, 0))

    def weigh(t):
        found = dict(zip(t.column("lang").to_pylist(), t.column("sums").to_pylist(), strict=True))
        share = {name: np.frombuffer(found[name]) / max(totals[name], 1e-9) for name in names}
        weights = np.zeros((PART, code.shape[1]), np.float32)
        for bit in range(code.shape[1]):
            one, zero = (np.log(np.mean([share[x] for x, c in zip(names, code[:, bit], strict=True) if c == side], axis=0) + 1e-6) for side in (1, -1))
            weights[:, bit] = one - zero
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary())})

    made = sums.groupBy("slice").applyInArrow(weigh, "slice int, weights binary").collect() if names else []  # the model's size
    weights = np.zeros((SLICES, PART, code.shape[1]), np.float32)
    for r in made:
        weights[r["slice"]] = np.frombuffer(r["weights"], np.float32).reshape(PART, -1)
    drop(sums)
    return Model(names, code, weights.reshape(PAIRS + TRIPLES, -1) if names else np.zeros((PAIRS + TRIPLES, 0), np.float32))


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, lead of the nearest codeword over the next) for rows of bit margins."""
    loss = np.exp(-np.clip(margins, -8, 8)[:, None, :] * code[None, :, :]).mean(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    near = np.take_along_axis(loss, order[:, :2], axis=1)
    share = np.exp(-loss)
    share /= share.sum(axis=1, keepdims=True)
    lead = (near[:, 1] - near[:, 0]) / (near[:, 1] + near[:, 0])
    return order[:, 0], np.take_along_axis(share, order[:, :1], axis=1)[:, 0], lead


def predict(texts: list[str | None], m: Model, margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of whole texts."""
    n, bits = len(texts), m.code.shape[1]
    raw = [(x or "").encode() for x in texts]
    lang, score, unsure = ["und"] * n, np.zeros(n), np.ones(n, bool)
    for a, b in chunks(raw) if m.languages else ():
        f, start, count = features(raw[a:b])
        margins = np.zeros((b - a, bits), np.float64)
        some = np.flatnonzero(count)
        if len(some) and bits:
            odds = m.weights[f[:, 0]] + m.weights[f[:, 1]]
            margins[some] = SCALE * np.add.reduceat(odds, start[some], axis=0, dtype=np.float64) / (2 * count[some, None])
        if len(m.languages) == 1:
            best, conf, lead = np.zeros(b - a, int), np.ones(b - a), np.ones(b - a)
        else:
            best, conf, lead = decode(margins, m.code)
        for i in range(b - a):
            if has_letter(texts[a + i]):
                lang[a + i], score[a + i], unsure[a + i] = m.languages[best[i]], conf[i], lead[i] < margin
    return lang, score, unsure


def classify(docs: DataFrame, model: Model, margin: float = 0.1) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row of docs."""
    shared = share(docs.sparkSession, model)  # 2 * 2**16 features x bits, 4 bytes each

    def run(batches):
        m = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score, unsure = predict(part.column(1).to_pylist(), m, margin)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])
        del m
        give_back()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_clear(docs: DataFrame, model: Model, margin: float = 0.1) -> DataFrame:
    """The rows of docs whose language is found without ambiguity, with all their columns."""
    shared = share(docs.sparkSession, model)
    text = docs.columns.index("text")

    def run(batches):
        m = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(~predict(part.column(text).to_pylist(), m, margin)[2]))
        del m
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


ship(__name__)
