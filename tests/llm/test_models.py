"""The classifiers against brute force: cosines of TF-IDF vectors, the risk and its slope; copies, ties and batches without a letter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import language, toxicity


def brute_vector(text, idf):
    """The TF-IDF vector of a text, one n-gram at a time."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    c = [32, *(ord(x) for x in " ".join(letters.split()) + " ")] if letters.strip() else []
    m = (1 << 64) - 1
    put = lambda h: (h * 0x9E3779B97F4A7C15 & m) >> 52
    tf = {}
    for i, x in enumerate(c):
        grams = [put(x)] if x != 32 else []
        if i + 1 < len(c):
            two = x << 21 | c[i + 1]
            grams.append(put(two ^ two >> 20))
            if i + 2 < len(c):
                three = (two << 21 | c[i + 2]) * 0xC2B2AE3D27D4EB4F & m
                grams.append(put(three ^ three >> 29))
        for g in grams:
            tf[g] = tf.get(g, 0) + 1
    v = {g: math.log1p(n) * float(idf[g]) for g, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / size for g, x in v.items()}


def test_language_is_the_nearest_centroid(spark, docs, prose):
    rows = [(i, prose(12) + (" straße" if i % 2 else " où ça"), "de" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample=40, centroids=3)
    fresh = [(100 + i, prose(7) + (" weiß!" if i % 3 else " là-bas, 12")) for i in range(20)]
    got = {r["doc_id"]: r for r in language.identify(docs(fresh), model).collect()}
    for i, text in fresh:
        v = brute_vector(text, model.idf)
        cosine = [sum(x * float(c[g]) for g, x in v.items()) for c in model.centroids]
        assert got[i]["lang_score"] == pytest.approx(max(cosine), abs=1e-4)
        assert got[i]["nearest"] == model.langs[int(np.argmax(cosine))]
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)


def test_language_of_batches_without_a_letter(spark):
    rows = [("123", "a")] * 50 + [("words of a", "a"), ("mots et b", "b")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(1).sortWithinPartitions("text"))
    assert sorted(set(model.langs)) == ["a", "b"]
    assert language.fit(spark.createDataFrame([("123", "a"), ("", "b")], "text string, lang string")).langs == []


def test_language_copies_ties_and_far_letters(spark, docs, prose):
    rows = [("copied text", "a")] * 20_000 + [(prose(6), "b") for _ in range(100)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(8), sample=40)
    assert model.langs.count("a") == 1 and set(model.langs) == {"a", "b"}
    same = language.fit(spark.createDataFrame([("one text", "z"), ("one text", "y")], "text string, lang string"))
    far = "\U00030001\U000323af"  # letters of the third ideographic plane
    got = {r["doc_id"]: r["nearest"] for r in language.identify(docs([(1, "one text"), (1, "one text"), (2, far), (3, "word " * 200_000)]), same).collect()}
    assert got == {1: "y", 2: "y", 3: "y"}


@pytest.mark.parametrize("shift", [-2.0, 0.0, 3.0])
def test_risk_and_slope(shift):
    rng = np.random.default_rng(4)
    xp, xu, w = rng.random((7, 5)) + shift * 0.2, rng.random((30, 5)), rng.normal(size=5)
    prior, decay = 0.4, 1e-3
    loss = lambda g: math.log1p(math.exp(-g))

    def brute(w, b, clamp=True):
        gp, gu = [float(x @ w + b) for x in xp], [float(x @ w + b) for x in xu]
        neg = sum(loss(-g) for g in gu) / len(gu) - prior * sum(loss(-g) for g in gp) / len(gp)
        pos = prior * sum(loss(g) for g in gp) / len(gp)
        return (pos + max(0.0, neg), neg) if clamp else (pos + neg, neg)

    risk, dw, db = toxicity.pu_risk(w, shift, xp, xu, prior, decay)
    want, neg = brute(w, shift)
    assert risk == pytest.approx(want)
    of = (lambda w, b: brute(w, b, False)[0]) if neg >= 0 else (lambda w, b: -brute(w, b)[1])
    for i in range(5):
        e = np.eye(5)[i] * 1e-5
        assert dw[i] - decay * w[i] == pytest.approx((of(w + e, shift) - of(w - e, shift)) / 2e-5, abs=1e-6)
    assert db == pytest.approx((of(w, shift + 1e-5) - of(w, shift - 1e-5)) / 2e-5, abs=1e-6)


def test_risk_of_overfitted_negatives_is_cut():
    xp, xu = np.full((4, 1), 10.0), np.full((6, 1), -10.0)
    risk, dw, _ = toxicity.pu_risk(np.ones(1), 0.0, xp, xu, 0.5, 0.0)
    assert risk < 1e-4 and dw[0] > 0  # descent lowers the weight


def test_toxicity_of_one_id_many_times(spark, docs, prose):
    bad = [(i, prose(30) + " grumblewort snarfulous") for i in range(12)]
    good = [(100 + i, prose(30)) for i in range(60)]
    many = [(7, prose(5) + " grumblewort")] * 50_000
    marks = spark.createDataFrame([(i, 0, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.nn_pu_fit
    try:
        toxicity.nn_pu_fit = lambda xp, xu, prior: seen.append((len(xp), len(xu))) or fit(xp, xu, prior)
        model = toxicity.fit(docs([*bad, *good, *many]).repartition(4).withColumn("h", F.lit("clash")).withColumn("confirmed", F.lit(1)), marks, sample_positive=10, sample_unlabelled=40)
    finally:
        toxicity.nn_pu_fit = fit
    assert seen == [(10, 40)]
    got = toxicity.scores(docs([(1, "x" * 1_000_000), (1, "x" * 1_000_000), (2, None)]), model).collect()
    assert len(got) == 3 and len({r["score"] for r in got}) == 1


def test_toxicity_remembers_few_words():
    """A task's memory of words is bounded, and each costs some bytes; what is forgotten is looked up again."""
    from motifloom.llm import toxicity

    words = ["".join(chr(97 + (i // 26**j) % 26) for j in range(5)) for i in range(150_000)]
    index = {f: i for i, f in enumerate(["=aaaaa", "^aaa", "^bcd", "aaaa$"])}
    known = {}
    for at in range(0, len(words), 1000):
        toxicity._vector(index, known, " ".join(words[at : at + 1000]))
        assert len(known) <= 100_001
    assert sum(map(len, known.values())) < 12 * len(known)
    text = "aaaaa baaaa bcdef bcdxy"
    again = toxicity._vector(index, known, text), toxicity._vector(index, {}, text)
    assert [list(x) for x in again[0]] == [list(x) for x in again[1]] and list(again[0][0]) == [0, 1, 2, 3]
