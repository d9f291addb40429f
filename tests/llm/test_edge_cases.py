"""Null doc_ids, clashing extra columns, empty tables and lost intermediates, for every operator alike."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavegrid.llm import _graph, _store, chat_format, fingerprint, language_id, lm_score, mixing, ngram_join, packing, quality_rules, sharding
from wavegrid.llm.words import spare

WORDS = [" ".join(f"{a}{i}" for i in range(60)) for a in "abcd"]
ROWS = [(None, WORDS[0]), (None, WORDS[0]), (None, None), (3, WORDS[1]), (3, WORDS[1]), (3, WORDS[2]), (4, ""), (None, WORDS[3])]
#: Names that the operators might use themselves.
EXTRA = ["bin", "size", "block", "key", "rate", "copy", "own", "known", "set_key", "row_number", "range", "score", "_key", "__key", "KEY2"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", 1, *range(len(EXTRA))) for k, (i, t) in enumerate(ROWS)], schema).repartition(3).cache()


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = Counter(i for i, _ in ROWS)


def test_every_row_comes_back(docs):
    assert ids(sharding.shard(docs, 4, 1)) == ALL
    assert ids(lm_score.score(docs, F.col("doc_id") == 3)) == ALL
    assert ids(fingerprint.fingerprint(docs)) == ALL
    assert ids(quality_rules.judge(docs)) == ALL
    assert ids(mixing.plan(docs)) == ALL
    assert ids(packing.pack(docs)) == ALL
    assert ids(ngram_join.join_components(docs)) == ALL
    assert ids(language_id.classify(docs, language_id.train(docs.where("doc_id is not null")))) == ALL


def test_null_ids_count_as_the_empty_text(spark):
    import zlib

    got = spark.createDataFrame([(None,), (7,)], "doc_id long").select(language_id.fold(F.col("doc_id"), 5).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(b"") % 5, zlib.crc32(b"7") % 5]


def test_stages_keep_extra_columns(docs):
    model = language_id.train(docs)
    for df in (quality_rules.keep_good(docs), language_id.keep_clear(docs, model), ngram_join.keep_one(docs), mixing.mix(docs)):
        assert df.schema.names == docs.schema.names
        assert all(tuple(r)[5:] == tuple(range(len(EXTRA))) for r in df.collect())
    assert len(ngram_join.keep_one(docs).collect()) == 6  # one of the equal rows without id, the blank, 3 twice, 4, and the last


def test_spare_names():
    assert spare(["Key", "_key", "x"], "key", "rate") == ["__key", "rate"]


def test_cluster_of_the_caller(spark):
    df = spark.createDataFrame([(i, "a b c d", f"s{i}", 1 + i // 2) for i in range(4)], "doc_id long, text string, source string, part int")
    bins = Counter((r.bin_id, (r.doc_id or 0) // 2) for r in packing.pack(df, 100, cluster=F.col("part")).collect())
    assert max(bins.values()) == 1


def test_components_of_long_chains_and_deleted_tables(spark):
    import os

    edges = spark.createDataFrame([(i * 7919 % 500, (i + 1) * 7919 % 500) for i in range(499)] + [(1000, 1001)], "u long, v long")
    roots = _graph.components(edges)
    got = {r.node: r.root for r in roots.collect()}
    assert len({got[i] for i in range(500)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 502
    left = [p for _, p in _store._WRITTEN.values()]
    assert any(os.path.exists(p) for p in left)
    _store.drop_all()
    assert not any(os.path.exists(p) for p in left) and not _store._WRITTEN


def test_chats_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, None, None, None, 1)], "conv_id long, turn long, role string, text string, turns int")
    out = chat_format.format_chats(df).collect()
    assert len(out) == 1 and out[0].conv_id is None and not out[0].valid
