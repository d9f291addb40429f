"""The pipeline against a plain version of every stage."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from wavegrid.llm import language_id, mixing, packing, quality_rules
from wavegrid.llm.language_id import codewords

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    en, de = ["the", "an", "ing", "re", "ou", "ti", "sh", "ble"], ["sch", "ein", "ung", "ver", "aus", "ich", "lich", "der"]
    clean = [prose(rng, en if i % 2 else de, 150 + i) for i in range(24)]
    near = " ".join([*clean[1].split()[:-3], "x", "y", "z"])
    mixed = " ".join(a for pair in zip(prose(rng, en, 90).split(), prose(rng, de, 90).split(), strict=True) for a in pair)
    junk = ["", None, "too short", "same words here " * 60, " | ".join(clean[3].split())]
    texts = [*clean, clean[1], near, mixed, *junk]
    return [(i, t, None if t is None else ["de", "en"][i % 2] if i < 24 else "en", [f"s{i % 3}", None][i % 7 == 6], len(t or "")) for i, t in enumerate(texts)]


def plain_good(rows):
    """Base counts by hand; the vocabularies' own measures against their bands, text by text."""
    content, pattern = quality_rules.load_vocabularies()
    fertility = [quality_rules.Fertility(name, data, pattern) for name, data in content]

    def kept(text, lang):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            cover |= {i, i + 1, i + 2} if twice[x] > 1 else set()
        if len(words) < 50 or 100 * len(cover) > 50 * len(words):
            return False
        for f, b in zip(fertility, quality_rules.BANDS, strict=True):
            ids = f.encode(text)
            share = [c / len(ids) for c in Counter(ids).values()]
            measures = len(ids), len(text) / len(ids), sum(bool(f.partial[i]) for i in ids) / len(ids), -sum(s * __import__("math").log2(s) for s in share)
            if not (b.languages.get(lang) or b.scripts[quality_rules.main_script(text)]).holds(*measures):
                return False
        return True

    return {r[0] for r in rows if kept(r[1], r[2])}


def plain_one_of_each(rows):
    sets = {}
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r[1])]
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


def plain_mix(rows):
    """doc_id -> copies, by filling targets source by source until none is above its limit."""
    import hashlib
    from math import floor

    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, open_ = {}, set(names)
    while open_:
        rest = 1.5 * sum(size.values()) - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] >= 2 * size[s]}
        if not over:
            fixed |= target
            break
        fixed |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    rate = {s: fixed[s] / size[s] for s in names}
    draw = lambda i: int(hashlib.md5(f"6:{i}".encode()).hexdigest()[:8], 16) / 2**32
    return Counter({r[0]: floor(rate[r[3]]) + (draw(r[0]) < rate[r[3]] - floor(rate[r[3]])) for r in rows})


def test_every_stage_against_a_plain_version(spark, planted):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_join", "mixing", "packing"]
    by = {r[0]: r for r in planted}
    stage = dict(corpus_pipeline.STAGES)
    frame = lambda ids: spark.createDataFrame([by[i] for i in ids], SCHEMA)
    ids_of = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = ids_of(stage["quality_rules"](spark, frame(by), ""))
    assert set(good) == plain_good(planted) and set(range(24)) - set(good) == set() and not {27, 28, 29, 30, 31} & set(good)

    docs = frame(good)
    clear = ids_of(stage["language_id"](spark, docs, ""))
    learn = docs.where(language_id.fold(docs.doc_id, 3) != 1)
    model = language_id.train(learn)
    assert (model.code == codewords(2)).all()
    _, _, unsure = language_id.predict([by[i][1] for i in good], model, 0.1)
    assert clear == [i for i, u in zip(good, unsure, strict=True) if not u] and set(range(24)) <= set(clear)

    one = ids_of(stage["ngram_join"](spark, frame(clear), ""))
    assert set(one) == plain_one_of_each([by[i] for i in clear]) and not {24, 25} & set(one)

    mixed = stage["mixing"](spark, frame(one), "")
    want = plain_mix([by[i] for i in one])
    assert Counter(ids_of(mixed)) == +want and mixed.columns == frame(one).columns

    plan = stage["packing"](spark, mixed, "").collect()
    placed, bins = Counter(), {}
    for r in plan:
        placed[r.doc_id] += r.words
        bins.setdefault(r.bin_id, []).append(r)
    assert placed == Counter({i: k * len(WORD.findall(by[i][1])) for i, k in want.items() if k})
    for b in bins.values():
        assert sum(r.words for r in b) <= packing.CAPACITY and len({r.source for r in b}) == len(b) == len({by[r.doc_id][1] for r in b})


def test_run_gives_the_same_plan(spark, planted, tmp_path):
    spark.createDataFrame(planted, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.createDataFrame(planted, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "w " * 80, None, None, None)] * 3])
def test_empty_and_null_tables(spark, tmp_path, rows):
    schema = SCHEMA + ", bin int, `key` string, size double"
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], schema).write.parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
