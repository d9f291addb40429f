"""The bands of op5 decide: noise that passes the base counts goes, labelled good text stays."""

import random

import pytest
from pyspark.sql import functions as F

from wavegrid.llm import quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id")


def verdicts(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, row struct<lang:string,text:string>").select("doc_id", "row.*")
    out = sorted(quality_rules.judge(df).collect(), key=lambda r: r.doc_id)
    return [r.kept for r in out if not r.base_failed]


def test_noise_past_the_base_counts_is_rejected(spark, labelled):
    rng = random.Random(7)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(n)) for _ in range(200))
    good = labelled.where("quality = 1 and lang = 'en'").orderBy("doc_id").limit(40).collect()
    good = [r.text for r in good if len(r.text.split()) >= 100]
    assert all(verdicts(spark, [("en", t) for t in good]))
    stuffed = [" ".join(w + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for w in t.split()) for t in good]
    cells = [" | ".join(t.split()) for t in good]
    noise = [words("abcdefghijklmnopqrstuvwxyz", 6), words("0123456789abcdef", 32)]
    for texts in (stuffed, cells, noise):
        out = verdicts(spark, [("en", t) for t in texts])
        assert len(out) >= 2 and not any(out)


def test_labelled_rows(spark, labelled):
    judged = quality_rules.judge(labelled).where("not base_failed").join(labelled.select("doc_id", "quality"), "doc_id")
    r = {x.quality: x for x in judged.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1].kept >= 0.99 * r[1].n
    assert r[0].kept <= 0.25 * r[0].n


def test_bands_are_those_of_the_sample(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    learnt, bands = quality_rules.learn_bands(read("documents"), read("labels")), quality_rules.Bands()
    assert learnt == {**bands.languages, "latin": bands.scripts["latin"]}


@pytest.mark.parametrize("at", [1, 2])
def test_bands_of_the_other_vocabularies(spark, at):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    learnt, bands = quality_rules.learn_bands(read("documents"), read("labels"), quality_rules.VOCABULARIES[at]), quality_rules.BANDS[at]
    assert learnt == {**bands.languages, "latin": bands.scripts["latin"]}


def test_other_vocabularies_decide(spark, labelled):
    """Digits read well as words of the first vocabulary; Spanish and French tables too."""
    rng = random.Random(8)
    noise = lambda letters, n, m: " ".join("".join(rng.choice(letters) for _ in range(n)) for _ in range(m))
    assert not any(verdicts(spark, [("en", noise("0123456789", 7, 60)), (None, noise("abcdefghijklmnopqrstuvwxyz", 6, 200)), (None, noise("0123456789abcdef", 32, 200))]))
    bad = labelled.where("quality = 0 and lang in ('es', 'fr')")
    one = quality_rules.judge(bad, (quality_rules.VOCABULARY,), (quality_rules.Bands(),)).where("kept").count()
    assert quality_rules.judge(bad).where("kept").count() < max(one, 1)
