"""The trained operators: held-out accuracy, and what happens without data or letters."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepflow.llm import common, language, quality, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred string"
WORDS = {
    "aa": "the of and tion ing er ly whose there".split(),
    "bb": "der und die keit ung schön über nicht".split(),
    "cc": "que les des été aux déjà où très".split(),
}


def texts_of(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "e"]) for _ in range(rng.randrange(8, 200))), lang, "s", "l"))
    rows += [(9000, None, "aa", "s", "l"), (9001, "", None, "s", "l"), (9002, "123 --- 45", "bb", "s", "l"), (9003, "x\0y", None, "s", "l")]
    rows += [(9004, " ".join(rng.choice(WORDS["bb"]) for _ in range(60_000)), None, "s", "l"), (9005, "the of", None, "s", "l"), (9005, "the of", None, "s", "l"), (None, "des été", "cc", "s", "l")]
    return spark.createDataFrame(rows, SCHEMA)


def test_language(spark):
    docs = texts_of(spark)
    network = language.fit(docs.filter("doc_id % 4 <> 2"))
    out = {}
    for r in language.identify(docs, network).collect():
        out.setdefault(r.doc_id, []).append(r)
    held = [i for i in range(240) if i % 4 == 2]
    assert np.mean([out[i][0].lang_pred == sorted(WORDS)[i % 3] for i in held]) > 0.95
    assert all(out[i][0].lang_pred == "und" and out[i][0].score == 0 for i in (9000, 9001, 9002))
    assert out[9004][0].lang_pred == "bb" and len(out[9005]) == 2 and len(out[None]) == 1
    kept = language.keep_identified(docs, network, 0.3)
    assert kept.columns == docs.columns and kept.filter("doc_id in (9000, 9001, 9002)").count() == 0
    assert kept.filter("doc_id < 240").count() == 240
    assert language.identify(docs.limit(0), network).count() == 0
    blank = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, blank).collect()} == {"und"}


def test_gradients():
    """The network's gradients are those of its loss."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 6, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language.train(x, y, ["a", "b", "c"], epochs=1)
    for name in ("vectors", "bias", "layer", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    weight = np.ones(3)

    def loss():
        p = language.softmax(np.maximum(net.pooled(x)[0] + net.bias, 0) @ net.layer + net.offset)
        return -np.log(p[np.arange(5), y]).mean()

    found = language.gradients(net, x, y, weight)
    for array, slope in zip([net.vectors, *net.filters, net.bias, net.layer, net.offset], found):
        for _ in range(4):
            at = tuple(rng.integers(n) for n in array.shape)
            if array is net.vectors:
                at = (int(x[0, 3]), at[1])
            old = array[at]
            array[at] = old + 1e-6
            up = loss()
            array[at] = old - 1e-6
            down = loss()
            array[at] = old
            assert (up - down) / 2e-6 == pytest.approx(slope[at], abs=2e-4)


def labelled(spark, sf_dir, column, modulus, fold):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs, labels.filter(F.col(column).isNotNull()), F.pmod(F.col("doc_id"), F.lit(modulus)) == fold


def test_quality_learns_repeats_and_marks(spark):
    rng = random.Random(4)
    words = [f"w{a}{b}" for a in "aeiou" for b in "bcdfgh"]
    rows = []
    for i in range(300):
        good = " ".join(rng.choice(words) for _ in range(60))
        bad = rng.choice([" ".join(f"{w}***" for w in good.split()), " ".join([rng.choice(words)] * 60)])
        rows.append((i, good if i % 3 else bad, int(bool(i % 3))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").withColumn("score", F.lit("x"))
    model = quality.fit(docs, docs.filter("doc_id % 5 <> 0"))
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(i % 3) for i in out if i % 5 == 0]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "w " * 300_000)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(odd, model).count() == 4 and quality.score(odd.limit(0), model).count() == 0
    empty = quality.fit(docs, docs.limit(0))
    assert 0 <= empty.score("anything") <= 1
    one = quality.fit(docs, docs.filter("quality = 1"))
    assert one.score("anything") > 0.5


def test_buckets_do_not_depend_on_slices(monkeypatch):
    text = "one two three fünf " * 40
    whole = np.bincount(np.concatenate(quality.buckets(text)), minlength=1 << 16)
    monkeypatch.setattr(quality, "SLICE", 64)
    cut = np.bincount(np.concatenate(quality.buckets(text)), minlength=1 << 16)
    # Only words and pairs at the edges of slices differ.
    assert np.abs(whole - cut).sum() < 0.1 * whole.sum()


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}{c}" for a in "bdgl" for b in "aeiou" for c in ("nd", "rt", "st", "ver")]
    hidden = ["vexmort", "vexlun", "vexdar", "vexum"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rng.randrange(80), rng.choice(hidden if i % 8 else ["you", "idiot", "moron", "m0ron"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("score", F.lit("x"))
    model = toxicity.fit(docs, docs.filter("doc_id % 5 <> 0"))
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in out if i % 5 == 0]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot " * 100_000)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, model).count() == 4 and toxicity.score(odd.limit(0), model).count() == 0
    assert 0 <= toxicity.fit(docs, docs.limit(0)).scores(["anything"])[0] <= 1


def test_isotonic():
    x, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    at, value = toxicity.isotonic(x, y, np.ones(6))
    assert (np.diff(value) >= 0).all() and list(at) == sorted(at)


@pytest.mark.parametrize("text", ["", "...", "A" * 10, "a b" * 9])
def test_features_are_finite(text):
    assert np.isfinite(toxicity.features(text, {"a ": 1.0})).all()


def test_samples_spread_over_ids(spark):
    """Not the lowest ids of a label: every tenth of the ids is in the sample in about its share."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    found = common.sample_ids(rows, "label", 200).collect()
    assert len({r.doc_id for r in found}) == len(found) == 400
    tenths = np.bincount([r.doc_id // 2000 for r in found], minlength=10)
    assert tenths.min() >= 20 and tenths.max() <= 65
    assert sorted(found) == sorted(common.sample_ids(rows.repartition(7), "label", 200).collect())
