"""Each operator against a plain version, on clean and on messy tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavegrid.llm import _blocks, _store, chat_format, fingerprint, language_id, lm_score, mixing, ngram_join, packing, quality_rules, queries, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block int, copies int, score double, bin_id long"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def messy():
    """Nulls, blanks, a very long text, copies, near copies, light sets, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 9, 12, 13, 15, 16, 40, 120, 300)]
    texts = [None, "", " \n\t ", "one", "One", "a b", "a b c", "É À ß 漢字 \U0001f600 x", *base, *base[:3]]
    for t in base:
        words = t.split()
        for cut in (1, 2, len(words) // 8):
            texts += [" ".join(words[cut:]), " ".join([*words, *["zz"] * cut]), t.upper()]
    texts += [sentence(rng, 20_000), base[7] + "\n" + base[7], "x " * 80]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "hot", "hot"][i % 5], 7, 1, 2, 3, 0.5, 9) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[0]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------------

URLS = [None, "no scheme", "://", "http://A.Example.com/en/1", "http://example.com/en/7x?q", "http://x.net/de/1", "http://example.net/de/8#a", "http://notexample.net/de/8",
        "https://bad.example.com/fr/1?utm_source=a", "http://www.bad.example.com/fr/1/", "http://bad.example.com/fr/2", "http://org/es/", "ftp://com/en", "http://com?x=/en/", "http://a.org://b/es/"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return low(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[8]])], "page_id long, url string, rule string")
    listed = url_filter.urls_on_hosts(pages.where("page_id = 8"), ["example.com"])
    out = {r.page_id: r for r in url_filter.filter_urls(pages, listed, queries.RULES).collect()}
    assert len(out) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        fit = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.rule), default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best.rule), url
        assert out[i].verdict == (best.verdict if best else "block" if i in (8, 9) else "allow"), url


@pytest.mark.parametrize("broadcast", [0, 1])
def test_url_list_keeps_no_false_positive(spark, monkeypatch, broadcast):
    """A filter of one block passes nearly all; the exact join must still decide."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    listed = pages.where("page_id < 900").select(url_filter.canonical(F.col("url")).alias("canonical_url"))
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", broadcast)
    out = url_filter.filter_urls(pages, listed, []).where("listed").agg(F.count("*"), F.max("page_id")).first()
    assert tuple(out) == (900, 899)


def test_filter_of_many_segments(spark, monkeypatch):
    """All listed URLs pass the filter, few others do."""
    monkeypatch.setattr(url_filter, "SEGMENT", 4)
    listed = spark.range(2000).select(F.concat(F.lit("h/"), "id").alias("canonical_url"))
    rows = {r.segment: list(r.words) for r in url_filter.bloom_filter(listed, 94).collect()}
    assert sorted(rows) == list(range(24)) and [len(rows[i]) for i in range(24)] == [16] * 23 + [8]
    tried = spark.range(4000).select("id", F.concat(F.lit("h/"), "id").alias("u"))
    at = tried.select("id", url_filter._block(F.col("u"), 94).alias("b"), F.array(*url_filter._mask(F.col("u"))).alias("m")).collect()
    passed = {r.id for r in at if all(rows[r.b // 4][r.b % 4 * 4 + i] & r.m[i] == r.m[i] for i in range(4))}
    assert set(range(2000)) <= passed and len(passed) < 2100
    pages = tried.select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), "u").alias("url"))
    assert url_filter.filter_urls(pages, listed, []).where("listed").count() == 2000


def test_many_rules_as_a_table(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = [*queries.RULES, url_filter.Rule("block", "/fr/2")]
    want = sorted(map(tuple, url_filter.filter_urls(pages, url_filter.urls_on_hosts(pages, ["a"]), rules).collect()), key=repr)
    monkeypatch.setattr(url_filter, "CASE_RULES", 0)
    assert sorted(map(tuple, url_filter.filter_urls(pages, url_filter.urls_on_hosts(pages, ["a"]), rules).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed").collect()), key=repr) == want


def test_url_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty, url_filter.urls_on_hosts(empty, ["a"]), queries.RULES).count() == 0


# 2 ---------------------------------------------------------------------------------------------------


def test_sharding(docs, rows, none):
    out = sharding.shard(docs, 16, 20).collect()
    n = len(rows)
    assert sorted(r.row_number for r in out) == list(range(n))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert sharding.locate(r.row_number, n, 16, 20) == (r.shard, r.slot)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(16)) <= 1
    assert sharding.shard(none).count() == 0 and sharding.shard(docs.limit(1)).count() == 1


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 1000, 4097):
        out = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 3)).collect()]
        assert sorted(out) == list(range(n))


# 3 ---------------------------------------------------------------------------------------------------


def plain_ctw(train, texts, depth):
    """The same tree with dictionaries and exact recursion."""
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        data = b" ".join(low(text).encode().split()) + b"\n"
        padded = bytes(depth) + data
        for i, byte in enumerate(data):
            context = padded[i : i + depth][::-1]
            for j in range(8):
                yield context, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1

    for t in train:
        for context, path, bit in steps(t):
            for d in range(depth + 1):
                counts[context[:d], path][bit] += 1
    below = defaultdict(set)
    for context, path in list(counts):
        if context:
            below[context[:-1], path].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(context, path):
        if (context, path) not in memo:
            own = kt(*counts[context, path])
            memo[context, path] = own if len(context) == depth else np.logaddexp(own, sum(weighted(c, path) for c in below[context, path])) - math.log(2)
        return memo[context, path]

    def one(context, path, d):
        node = counts.get((context[:d], path), [0, 0])
        own = (node[1] + 0.5) / (sum(node) + 1)
        if d == depth or (context[: d + 1], path) not in counts:
            return own
        stop = math.exp(kt(*node) - weighted(context[:d], path)) / 2
        return stop * own + (1 - stop) * one(context, path, d + 1)

    def code(text):
        total = 0.0
        for context, path, bit in steps(text):
            p = one(context, path, 0) if ((b"", path) in counts) else 0.5
            total += math.log10(p if bit else 1 - p)
        return total

    return [code(t) for t in texts]


def test_lm_score(spark):
    rng = random.Random(1)
    texts = [None, "", "Aa aA", "é ß", *[sentence(rng, rng.randint(1, 30), "abc") for _ in range(12)]]
    texts += texts[4:6]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, learn int")
    out = {r.doc_id: r for r in lm_score.score(df, F.col("doc_id") % 3 != 1).collect()}
    train = [t for i, t in enumerate(texts) if i % 3 != 1]
    for i, want in enumerate(plain_ctw(train, texts, lm_score.DEPTH)):
        assert out[i].score == pytest.approx(want, rel=1e-5), i
    c = Counter(w for t in train for w in [*WORD.findall(low(t)), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*WORD.findall(low(t)), "\n"]
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


def test_lm_score_messy(docs, rows, none):
    out = lm_score.score(docs, F.lit(True))
    assert out.count() == len(rows) and out.where("score >= 0 or score is null or isnan(score)").count() == 0
    untrained = lm_score.score(docs.where("length(text) < 50"), F.lit(False)).collect()
    assert all(r.score == pytest.approx(-r.n_bytes * 8 * math.log10(2)) and r.n_known == 0 for r in untrained)
    assert lm_score.score(none, F.lit(True)).count() == 0


def test_lm_score_in_small_slices(spark, docs, monkeypatch):
    """Slices and block sizes change nothing."""
    want = sorted(map(tuple, lm_score.score(docs, F.col("doc_id") % 2 == 0).collect()), key=repr)
    monkeypatch.setattr(lm_score, "SLICE", 64)
    monkeypatch.setattr(lm_score.B, "BLOCK_BYTES", 20_000)
    got = sorted(map(tuple, lm_score.score(docs, F.col("doc_id") % 2 == 0).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9) if a[0] is not None else True


def test_lm_score_holds_a_block_in_parts():
    """Repeated keys are merged early, batches hold a part of a block's keys, and a look-up holds few copies of its text."""
    B, rng = lm_score.B, random.Random(3)
    tally, keys = B.Tally(), np.arange(100_000, dtype=np.uint64)
    for _ in range(40):
        tally.add(keys, np.ones(len(keys), np.int64))
        assert sum(x.nbytes for x in tally.keys + tally.counts) <= 40 * len(keys)
    assert [x.tolist() for x in tally.total()] == [keys.tolist(), [40] * len(keys)]

    lines, ranges, key = [sentence(rng, 12, "abcdefghijklmno") for _ in range(9000)], 24, (pa.scalar(5, pa.int32()),)
    docs = pa.table({"doc_id": list(range(2500)), "text": [" ".join(rng.choice(lines) for _ in range(80)) for _ in range(2500)], "learn": [i % 5 > 0 for i in range(2500)]})
    size, answers = sum(map(len, docs.column("text").to_pylist())), []
    grams = np.unique(lm_score.stream(lm_score.spaced(B.texts_of(docs)))[0])
    words = np.unique(lm_score.Words(B.texts_of(docs)).hash)
    for kind, k in ((lm_score._GRAM, grams), (lm_score._WORD, words)):
        r = lm_score._ranges_of(kind, k, ranges)
        answers += [{"kind": kind, "range": x, "values": B.pack(k[r == x].astype(lm_score._VALUE[kind]) % 1000)} for x in range(ranges)]
    answers = pa.Table.from_pylist(answers)
    tracemalloc.start()
    out = lm_score._finisher(10, 10, 1, ranges)(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = lm_score.stream(lm_score.spaced(B.texts_of(docs.slice(7, 1))))[0]
    assert out.num_rows == 2500 and out.column("score")[7].as_py() == pytest.approx(-int((one.astype(np.uint32) % 1000).sum()) / lm_score._FINE)
    assert peak < 10 * size

    batches = list(lm_score._sender(ranges)(key, iter(docs.to_batches(max_chunksize=900))))
    sent = pa.Table.from_batches(batches)
    assert max(b.nbytes for b in batches) < sent.nbytes / 8 and sent.num_rows == 2 * ranges
    for kind, want in ((lm_score._GRAM, grams), (lm_score._WORD, words)):
        _, keys, k, c = lm_score._merged(sent, kind)
        assert k.tolist() == want.tolist() and sum(map(len, keys)) == len(want)
        taught = [x for x, t in zip(B.texts_of(docs), docs.column("learn").to_pylist(), strict=True) if t]
        assert c.sum() == (lm_score.Words(taught).counts.sum() if kind == lm_score._WORD else sum(len(x) for x in lm_score.spaced(taught)))


def test_counts_beyond_32_bits():
    keys, counts = np.array([3, 9, 1 << 63], np.uint64), np.array([1, (1 << 33) + 5, 2], np.uint64)
    rows = lm_score.B.entries(0, lm_score._WORD, lm_score.B.range_of(keys, 1), keys, counts) * 2
    _, _, k, c = lm_score._merged(lm_score.B.table(rows, lm_score.B.ENTRY_FIELDS), lm_score._WORD)
    assert k.tolist() == keys.tolist() and c.tolist() == [2, (1 << 34) + 10, 4]
    assert lm_score._VALUE[lm_score._WORD](c[1]) == c[1]


def test_log_gamma():
    x = np.concatenate((np.arange(0.5, 50, 0.5), [1e3, 1e6 + 0.5, 1e9]))
    assert np.allclose(lm_score._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


# 4 ---------------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows, none):
    out = fingerprint.fingerprint(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    texts = [(i, t or "") for i, t in sorted({(r[0], r[1] or "") for r in rows})]
    by = {r.doc_id: r for r in out}
    errors, prints = [], defaultdict(set)
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints[tuple(sorted(Counter(WORD.findall(low(t))).items()))].add(r.fingerprint)
        for other, near in ((edited, r.near_edited), (nxt, r.near_next)):
            a, b = Counter(WORD.findall(low(t))), Counter(WORD.findall(low(other)))
            true = 1.0 if not a and not b else sum((a & b).values()) / sum((a | b).values())
            errors.append(near - true)
            assert abs(near - true) < 0.45 and 0 <= near <= 1
    assert all(len(x) == 1 for x in prints.values()) and abs(np.mean(errors)) < 0.03
    assert fingerprint.fingerprint(none).count() == 0


def test_fingerprint_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "d e"), (3, "f")], "doc_id long, text string")
    out = fingerprint.fingerprint(df).collect()
    assert sorted(r.n_chars for r in out) == [1, 1, 3, 3] and [r.doc_id for r in out].count(None) == 2


def generated_rows(node):
    """Rows that explode made in a finished plan."""
    name, children = node.nodeName(), node.children()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [children.apply(i) for i in range(children.size())]
    return (node.metrics().apply("numOutputRows").value() if name.startswith("Generate") else 0) + sum(map(generated_rows, below))


def test_fingerprint_work_is_by_words_not_by_samples(spark):
    texts = [" ".join(f"{d} w{i % 300}" for i in range(500)) for d in range(20)]
    df = fingerprint.signatures(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ["id"])
    assert len(df.collect()) == len(texts)
    assert generated_rows(df._jdf.queryExecution().executedPlan()) == 2 * 1000 * len(texts)


@pytest.mark.parametrize("size", [3, 40])
def test_likeness_follows_the_binomial_law(spark, size):
    rng, pairs, true = random.Random(size), [], []
    for p in range(400):
        a, b = (Counter(f"{p}-{rng.randrange(size)}" for _ in range(2 * size)) for _ in "ab")
        pairs.append((p, " ".join(a.elements()), " ".join(b.elements())))
        true.append(sum((a & b).values()) / sum((a | b).values()))
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    a, b = (fingerprint.signatures(df.select("id", F.col(c).alias("text")), ["id"]).withColumnRenamed("signature", c) for c in "ab")
    near = {r.id: r.x for r in a.join(b, "id").select("id", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    errors, true = np.array([near[p] for p in range(400)]) - true, np.array(true)
    spread = true * (1 - true) / fingerprint.SAMPLES
    assert abs(errors.sum()) < 4 * math.sqrt(spread.sum())
    assert 0.7 < (errors**2).sum() / spread.sum() < 1.3  # 1 give or take 0.07


# 5 ---------------------------------------------------------------------------------------------------


def test_quality_counts(docs, rows, none):
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if c[x] > 1:
                cover |= {i, i + 1, i + 2}
        lines = t.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        o = by[r[0]]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words, o.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed)
        assert not (o.base_failed and o.kept)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns


def test_quality_keeps_prose_and_drops_noise(spark, small):
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(4)) for _ in range(200))
    same = " ".join(f"{'=' * k} {'-' * (k % 7)} " for k in range(1, 60)) + " x" * 10
    df = spark.createDataFrame([(1, noise, "en"), (2, same * 3, "en")], "doc_id long, text string, lang string")
    assert not any(r.kept for r in quality_rules.judge(df).collect())
    clean = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet").where("quality = 1"), "doc_id")
    r = quality_rules.judge(clean).agg(F.sum(F.col("kept").cast("int")), F.sum((~F.col("base_failed")).cast("int"))).first()
    assert r[0] == r[1]
    assert quality_rules.keep_good(clean).columns == clean.columns


def plain_measures(f, text):
    ids = f.encode(text)
    c = Counter(ids)
    share = sum(bool(f.partial[i]) for i in ids)
    h = -sum(x / len(ids) * math.log2(x / len(ids)) for x in c.values())
    return (len(ids), len(text) / len(ids), share / len(ids), h) if ids else (0, 0, 0, 0)


@pytest.fixture(scope="module")
def vocabularies():
    content, pattern = quality_rules.load_vocabularies()
    return [quality_rules.Fertility(name, data, pattern) for name, data in content]


def test_fertility_of_each_vocabulary(rows, vocabularies):
    texts = [r[1] or "" for r in rows] + ["漢字 кириллица 😀 ok", "éü"]
    for f in vocabularies:
        out = f(texts)
        for i, t in enumerate(texts):
            assert tuple(out[k][i] for k in quality_rules.MEASURES) == pytest.approx(plain_measures(f, t), abs=1e-9)
    assert any(f(["漢字 кириллица"])["byte_share"][0] > 0 for f in vocabularies)


def test_segments_and_runs_change_no_token(rows, vocabularies, monkeypatch):
    texts = [r[1] or "" for r in rows] + ["a b  c\n d e , f 1 2 \u2581 g \u2581h é f \xa0 i"]
    whole = [[f.encode(t) for t in texts] for f in vocabularies]
    monkeypatch.setattr(quality_rules, "SEGMENT", 7)
    for f, want in zip(vocabularies, whole, strict=True):
        assert [sum((f.encode(p) for p in quality_rules.segments(t, f.byte_level)), []) for t in texts] == want
    for f in vocabularies[:2]:
        for t in ("a" + " " * 30_000 + "b", "a" + " " * 25_000, "\n" * 25_000 + "x" + "\u3000" * 30_000 + "\t9", "\x1c" * 30_000):
            assert f.encode(t) == f.encoding.encode_ordinary(t)


def test_quality_of_very_long_texts(spark):
    m = 1_000_000
    texts = [" " * m, "\n" * m + "x", "a" * m, "1" * m, "é" * m, "word " * (m // 5)]
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    assert [out[i].n_words for i in range(6)] == [0, 1, 1, 1, 1, m // 5] and not any(r.kept for r in out.values())
    assert all(r.n_tokens > 0 for r in out.values())


def test_scripts():
    assert [quality_rules.main_script(x) for x in (None, "12 -", "abc", "Привет a", "漢字かな a", "éàü")] == ["none", "none", "latin", "alphabetic", "ideographic", "latin"]


# 6 ---------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, highest=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        rest = share * sum(sizes.values()) - sum(fixed.values())
        t = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if t[s] >= highest * sizes[s]}
        if not over:
            return fixed | t
        fixed |= {s: highest * sizes[s] for s in over}
        left -= over
    return fixed


def test_mixing(docs, rows, none):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    out = mixing.plan(docs).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert got(mixing.plan(docs), "doc_id", "taken") == got(mixing.plan(docs.repartition(7)), "doc_id", "taken")
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({i: sum(r.copies for r in out if r.doc_id == i) for i in source if any(r.copies for r in out if r.doc_id == i)})
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0 and mixing.plan(none).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.element_at(F.array(*map(F.lit, "abcc")), (F.col("id") % 4 + 1).cast("int")).alias("source"))
    for r in mixing.plan(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert r.t == pytest.approx(r.target, rel=0.05)


# 7 ---------------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 60, 300))[::-1]
    source, cluster = rng.integers(0, 5, 300), rng.integers(0, 80, 300)
    where = packing.best_fit(size, np.stack((source, 5 + cluster), axis=1), 85, 100)
    left, held = [], []
    for i in range(300):
        ok = [(left[b], b) for b in range(len(left)) if left[b] >= size[i] and not held[b] & {(0, source[i]), (1, cluster[i])}]
        if ok:
            assert left[where[i]] == min(ok)[0] and any(b == where[i] for _, b in ok)
        else:
            assert where[i] == len(left)
            left.append(100), held.append(set())
        left[where[i]] -= size[i]
        held[where[i]] |= {(0, source[i]), (1, cluster[i])}


def test_packing(docs, rows, none):
    out = packing.pack(docs, 100).collect()
    words, bins = Counter(), defaultdict(list)
    for r in out:
        words[r.row_number] += r.words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert sorted(words.values()) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    text = {r[0]: r[1] for r in rows}
    for b in bins.values():
        assert sum(r.words for r in b) <= 100 and sorted(r.place for r in b) == list(range(len(b)))
        assert len({r.source for r in b}) == len(b) == len({text[r.doc_id] for r in b})
    assert packing.pack(none).count() == 0


# 8 ---------------------------------------------------------------------------------------------------


def plain_components(rows, width, threshold):
    sets = {}
    for r in rows:
        w = WORD.findall(low(r[1]))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def plain_links(rows, width, threshold):
    """Other rows that each row links with."""
    words = [WORD.findall(low(r[1])) for r in rows]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= threshold * len(a | b)
    return Counter((r[0], sum(linked(a, b) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("width", "threshold"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(docs, rows, width, threshold):
    want = plain_components(rows, width, threshold)
    out = ngram_join.join_components(docs, width, threshold).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert Counter((r.doc_id, r.n_links) for r in out) == plain_links(rows, width, threshold)


def test_ngram_join_across_chunks(spark):
    """One group of near copies that no task may hold whole."""
    rng = random.Random(3)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"q{i}"
        rows.append((i, " ".join(w) if i % 9 else " ".join([*w[: 30 + i // 3], f"r{i}"])))
    rows += [(60 + i, rows[i][1]) for i in range(0, 60, 7)]
    before, ngram_join.GROUP = ngram_join.GROUP, 7
    try:
        out = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    finally:
        ngram_join.GROUP = before
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(rows, 3, 80)
    assert Counter((r.doc_id, r.n_links) for r in out) == plain_links(rows, 3, 80)


def test_join_functions_send_their_results_in_parts():
    """What the JVM holds of a block at once is a part of it."""
    rng = random.Random(5)
    docs = pa.table({"doc_id": pa.array(range(600), pa.int64()), "text": [" ".join(rng.choices("abcdefghij", k=600)) for _ in range(600)]})
    send = ngram_join._sender(4, 64)
    whole, parts = send((pa.scalar(3),), docs), _store.lean(send)((pa.scalar(3),), docs)
    answers = ngram_join._answer(None, whole.set_column(4, "counts", [[_blocks.pack(np.full(len(x) // 8, 2, np.uint8)) for x in whole.column("keys").to_pylist()]]))
    finish = ngram_join._finisher(4, 85, 0)
    both = [(pa.concat_tables([whole] * 40), None), (finish(docs, answers), _store.lean(finish)(docs, answers))]
    assert parts.equals(whole)
    for plain, sent in both:
        sent = _store.in_parts(plain) if sent is None else sent
        assert sent.equals(plain) and plain.nbytes > 2 * _store.PART_BYTES
        assert max(b.nbytes for b in sent.to_batches()) < 1.5 * _store.PART_BYTES
    assert _store.in_parts(docs.slice(0, 0)).equals(docs.slice(0, 0))


def test_ngram_join_in_small_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(_store, "PART_BYTES", 500)
    monkeypatch.setattr(ngram_join, "ROWS", 7)
    out = ngram_join.join_components(docs, 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(rows, 5, 80)
    assert Counter((r.doc_id, r.n_links) for r in out) == plain_links(rows, 5, 80)
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {c for _, c in plain_components(rows, 5, 80).values()}


def test_keep_one(docs, rows, none):
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    want = {c for i, (_, c) in plain_components(rows, 5, 80).items()}
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert ngram_join.keep_one(none).columns == none.columns and ngram_join.join_components(none).count() == 0


def test_light_subsets_prove_links():
    for t in (80, 85):
        for a in range(1, ngram_join.largest_light(t) + 1):
            for b in range(a, ngram_join.largest_light(t) + 1):
                o = ngram_join.least_overlap(a, b, t)
                assert o > a or (o in ngram_join._overlaps(a, t) and o in ngram_join._overlaps(b, t)) == (100 * a >= t * b)


def test_boundary_follows_the_sizes():
    """More short sets that heavy ones may link with make it worth to list their subsets."""
    of = lambda sets: ngram_join.light_boundary(85, sets)
    assert of({}) == 0 and of({500: 9}) == 0
    found = {of({s: 100, 500: 9}) for s in range(1, 20)}
    assert len(found) > 3 and max(found) <= ngram_join.largest_light(85)
    for s in range(1, 8):
        assert of({s: 100}) >= s


@pytest.mark.parametrize("sets", [{}, {9: 10, 12: 10}, {20: 1}])
def test_any_boundary_gives_the_same_links(spark, docs, rows, sets, monkeypatch):
    monkeypatch.setattr(ngram_join, "_sizes", lambda *a: (1000, sets))
    out = ngram_join.join_components(docs, 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == plain_components(rows, 4, 85)
    assert Counter((r.doc_id, r.n_links) for r in out) == plain_links(rows, 4, 85)


def test_ngram_join_without_doc_ids(spark):
    a = " ".join(f"a{i}" for i in range(40))
    out = ngram_join.join_components(spark.createDataFrame([(None, a), (None, a), (4, a), (None, "b c d e f g"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.n_links) for r in out if r.component_id) == [(False, 4, 2), (True, 4, 2), (True, 4, 2)]
    assert [r.n_links for r in out if r.component_id is None] == [0, 0]


# 9 ---------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "&lt;&amp;", "", None, "a\nb", "\U0001f600 é"]
    turns = [(1, i, ["user", "assistant"][i % 2], t, 5) for i, t in enumerate(texts)] + [(2, 0, None, "x", 1), (2, 0, "to<ol\n", "y", 1), (None, None, "user", "z", 1), (None, None, "user", "z", 1), (3, 1, "user", "q", 1), (3, 2, "assistant", "p", 1), (3, 0, "system", "s", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat_format.format_chats(df).withColumns({"back": chat_format.parse_chats(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))}).collect()}
    for conv, r in out.items():
        mine = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert [(x.role, x.text) for x in r.back] == [(b, c) for _, b, c in mine]
        assert r.loss == "".join(c for _, b, c in mine if b == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert [out[k].valid for k in (1, 2, None, 3)] == [False, False, False, True]
    assert chat_format.format_chats(df.where("false")).count() == 0


# 10 --------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = queries.op10_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_edges(docs, rows, none):
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    out = language_id.classify(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for r in rows:
        assert (by[r[0]].lang_pred == "und") == (not any(c.isalpha() for c in r[1] or "")), r[1]
    nothing = language_id.train(none)
    assert {r.lang_pred for r in language_id.classify(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.classify(docs, one).collect()} == {"en", "und"}
    assert language_id.keep_clear(docs, model).columns == docs.columns and language_id.classify(none, model).count() == 0


def plain_grams(text):
    """Byte pairs and hashed triples of a text whose other ASCII characters than letters are blanks."""
    data = [32 if c < 128 and not chr(c).isalpha() else c for c in low(text).encode()]
    data = [32, *data, 32]
    out = []
    for i in range(len(data) - 1):
        a, b = data[i], data[i + 1]
        c = data[i + 2] if i + 2 < len(data) else 32
        if not (a == b == 32):
            out += [a << 8 | b, (((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16) + (1 << 16)]
    return out


def plain_model(rows):
    """Share of each gram by language, a document weighing the same whatever its length."""
    sums = defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            grams = plain_grams(text)
            sums[lang]["all"] += 0
            for g in grams:
                sums[lang][g] += 2 / len(grams)
    return {k: {g: v / max(sum(c.values()), 1e-9) for g, v in c.items()} for k, c in sums.items()}


def plain_language(text, share):
    """(language, score, lead) by one naive Bayes classifier for each split of the languages."""
    names = sorted(share)
    splits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(len(names))] for b in range(1, 1 << (len(names) - 1))]
    grams, margins = plain_grams(text), []
    for split in splits:
        side = lambda g, s: math.log(np.mean([share[n].get(g, 0) for n, c in zip(names, split) if c == s]) + 1e-6)  # noqa: B023, B905, E731
        margins.append(language_id.SCALE * sum(side(g, 1) - side(g, -1) for g in grams) / len(grams))
    loss = [np.mean([math.exp(-max(-8, min(8, m)) * split[i]) for m, split in zip(margins, splits)]) for i in range(len(names))]  # noqa: B905
    order = sorted(range(len(names)), key=lambda i: loss[i])
    a, b = loss[order[0]], loss[order[1]]
    return names[order[0]], math.exp(-a) / sum(math.exp(-x) for x in loss), (b - a) / (a + b)


def test_language_against_plain_version(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "ghijkl"}
    rows = [(sentence(rng, rng.randint(2, 20), letters[k]), k) for k in letters for _ in range(8)] + [(None, "aa"), ("xyz", None), ("", "bb"), ("12 34", "cc")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model, share = language_id.train(df), plain_model(rows)
    assert model.languages == sorted(letters)
    tests = [sentence(rng, rng.randint(1, 12), x) for x in [*letters.values(), "abcdefghijkl"] for _ in range(6)]
    one, other = sentence(rng, 60, "abcdef").split(), sentence(rng, 60, "ghijkl").split()
    tests += [" ".join(one[:k] + other[k:]) for k in range(61)]  # from one language to another, word by word
    out = {r.doc_id: r for r in language_id.classify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    flags = []
    for i, t in enumerate(tests):
        name, score, lead = plain_language(t, share)
        assert (out[i].lang_pred, out[i].ambiguous) == (name, lead < 0.1) or abs(lead - 0.1) < 1e-4 or lead < 1e-4
        assert out[i].score == pytest.approx(score, abs=1e-4)
        flags.append(out[i].ambiguous)
    assert not any(flags[:6]) and not any(flags[12:18]) and any(flags[24:]) and not flags[24] and not flags[-1]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = language_id.codewords(n)
        assert len(code) == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
