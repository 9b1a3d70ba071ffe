"""Toxicity by non-negative positive-unlabelled learning.

A numpy classifier learns from documents confirmed as toxic and from unlabelled ones, which hold toxic documents too.
The risk of Kiryo et al. (2017) corrects for that by the class prior: with the loss l and the prior p it is
p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]). Features are words and beginnings and ends of words; a document's value of a
feature is how many of its distinct words have it, on a log scale. Executors count and vectorise; the driver sees a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.common import pinned, trim

#: The classifier is fitted on so many confirmed and so many unlabelled documents at most.
SAMPLE_POSITIVE = 4_000
SAMPLE_UNLABELLED = 12_000
N_FEATURES = 1024
#: A feature whose rates differ by fewer deviations is noise among hundreds of thousands of features.
LEAST_Z = 3.0
THRESHOLD = 0.7
_words = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[str]:
    """Of a lower-case word: itself, its first 3 to 6 letters and its last 4."""
    out = [f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n)]
    return [*out, f"{word[-4:]}$"] if len(word) >= 4 else out


def words_of(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


class Model(NamedTuple):
    features: dict[str, int]
    weight: np.ndarray
    bias: float


#: Counted as a feature of every document.
ALL = ""
#: Features that a task counts before it gives them away, but for those of one document more.
HELD = 200_000
#: Words whose features a task remembers, as 4 bytes for each feature.
WORDS_HELD = 100_000


def _sampled(keys: DataFrame, most: int, seed: int) -> DataFrame:
    """most distinct keys (doc_id, h) at most, those of the least hashes."""
    return keys.select("doc_id", "h").distinct().withColumn("order", F.xxhash64("doc_id", "h", F.lit(seed))).orderBy("order", "doc_id", "h").limit(most).select("doc_id", "h")


def _counted(rows: DataFrame) -> DataFrame:
    """feature, p, u: the confirmed and all rows (text, confirmed) that have it; the feature ALL counts the rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {ALL: 0}
        known: dict[str, bytes] = {}  # the numbers of a word's features
        has, last = np.zeros((2, 2 * HELD), np.int64), np.zeros(2 * HELD, np.int64)

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"feature": list(number), "p": has[0, : len(number)], "u": has[1, : len(number)]})
            number.clear()
            known.clear()
            number[ALL] = 0
            has[:] = 0
            return out

        def numbers(word: str) -> bytes:
            got = known[word] = np.array([number.setdefault(f, len(number)) for f in features_of(word)], np.int32).tobytes()
            return got

        for b in batches:
            for text, confirmed in zip(b["text"].array, b["confirmed"].array, strict=True):
                every = [known[w] if w in known else numbers(w) for w in words_of(text)]
                ids = np.frombuffer(b"".join([b"\0\0\0\0", *every]), np.int32)
                if len(number) > len(last):  # a text of very many words
                    more = len(number) - len(last) + HELD
                    has, last = np.pad(has, ((0, 0), (0, more))), np.pad(last, (0, more))
                # the last place of each number, so that each counts once
                order = np.arange(len(ids))
                last[ids] = order
                own = ids[last[ids] == order]
                has[1, own] += 1
                if confirmed:
                    has[0, own] += 1
                if len(number) > HELD:
                    yield flush()
                elif len(known) > WORDS_HELD:
                    known.clear()
        yield flush()
        known.clear()
        number.clear()
        trim()

    return rows.select("text", "confirmed").mapInPandas(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _vector(index: dict[str, int], known: dict[str, bytes], text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text that the index has, and their values; known keeps each word's features."""
    every = []
    for w in words_of(text):
        i = known.get(w)
        if i is None:
            if len(known) > WORDS_HELD:
                known.clear()
            i = known[w] = np.array([index[f] for f in features_of(w) if f in index], np.int32).tobytes()
        if i:
            every.append(i)
    n = np.bincount(np.frombuffer(b"".join(every), np.int32)) if every else np.zeros(0, np.int64)
    i = np.flatnonzero(n)
    return i, (1 + np.log(n[i])).astype(np.float32)


def pu_risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray, float]:
    """The non-negative PU risk (without the decay) of a linear model with logistic loss, and the direction of descent of weights
    and bias: the gradient, or where the risk of the negatives is below 0, that which raises it again."""
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    gp, gu = xp @ w + b, xu @ w + b
    sp, su = sigmoid(gp), sigmoid(gu)
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    risk = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
    # the derivatives of l(g) = log(1 + exp(-g)) and of l(-g) by g
    dp_neg, du_neg = prior * sp / len(xp), su / len(xu)
    if negative >= 0:
        dp, du = prior * (sp - 1) / len(xp) - dp_neg, du_neg
    else:  # the risk of the negatives is overfitted: step back
        dp, du = dp_neg, -du_neg
    return float(risk), xp.T @ dp + xu.T @ du + decay * w, float(dp.sum() + du.sum())


def nn_pu_fit(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with logistic loss, by Adam on the non-negative PU risk of confirmed xp and unlabelled xu."""
    w, b = np.zeros(xp.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        _, dw, db = pu_risk(w, b, xp, xu, prior, decay)
        grad = np.append(dw, db).astype(np.float32)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED, n_features: int = N_FEATURES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) of the rows to learn from.

    Confirmed are the documents with label 1; all documents, whatever their label, are the unlabelled. The prior is the
    part of label 1 among the labels of docs, held between 0.001 and 0.9. Features are counted and chosen over all of both; the
    optimiser sees a sample of at most sample_positive and sample_unlabelled rows, those of the least hashes, where rows of equal
    doc_id and text are one. Null texts, ids and labels are left out; of several labels of an id the greatest counts. Without a
    confirmed document the model gives 0 to all. Extra columns are ignored.
    """
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marks.join(own.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.avg("toxic")).first()[0] or 0.0
    toxic = pinned(marks.where("toxic = 1").select(F.col("doc_id").alias("_toxic")))
    few = toxic.count() <= 500_000  # 8 bytes each
    every = own.join(F.broadcast(toxic) if few else toxic, F.col("doc_id") == F.col("_toxic"), "left").select("doc_id", "text", F.col("_toxic").isNotNull().alias("confirmed"))
    # features are counted over every document, not over the sample
    counted = pinned(_counted(every))
    n = counted.where(F.col("feature") == ALL).select("p", "u").first()
    if n is None or not n["p"]:
        return Model({}, np.zeros(0, np.float32), -30.0)
    # what tells confirmed from unlabelled best: the difference of the two rates against its deviation
    p, u = F.col("p") / n["p"], F.col("u") / n["u"]
    mean = (F.col("p") + F.col("u")) / (n["p"] + n["u"])
    z = (p - u) / F.sqrt((mean * (1 - mean) + F.lit(1.0 / (n["p"] + n["u"]))) * (1.0 / n["p"] + 1.0 / n["u"]))
    best = counted.where((F.col("feature") != ALL) & (F.col("p") + F.col("u") >= 3)).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    index = {r["feature"]: i for i, r in enumerate(best.orderBy(F.desc("z"), "feature").limit(n_features).collect())}

    keys = every.select("doc_id", F.xxhash64("text").alias("h"), "confirmed")
    confirmed, unlabelled = _sampled(keys.where("confirmed"), sample_positive, 1), _sampled(keys, sample_unlabelled, 2)
    picked = pinned(confirmed.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))))
    # the sample's size bounds what is broadcast; texts are not shuffled
    rows = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "h"])

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bytes] = {}
        seen: set[tuple] = set()  # as many as the sample at most
        for b in batches:
            got = []
            for doc_id, h, positive, text in zip(b["doc_id"].array, b["h"].array, b["positive"].array, b["text"].array, strict=True):
                if (doc_id, h, positive) not in seen:
                    seen.add((doc_id, h, positive))
                    i, v = _vector(index, known, text)
                    got.append((doc_id, h, positive, i.astype(np.int32), v))
            if got:  # an empty frame has no type for its lists
                yield pd.DataFrame(got, columns=["doc_id", "h", "positive", "i", "v"])
        known.clear()
        trim()

    vectors = rows.mapInPandas(vectorise, "doc_id long, h long, positive boolean, i array<int>, v array<float>")
    sample = vectors.dropDuplicates(["doc_id", "h", "positive"]).toPandas().sort_values(["positive", "doc_id", "h"])

    def dense(some: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(some), len(index)), np.float32)
        for row, (i, v) in enumerate(zip(some["i"], some["v"], strict=True)):
            x[row, np.asarray(i, np.int64)] = v
        return x

    positive = sample["positive"].to_numpy(bool)
    w, b = nn_pu_fit(dense(sample[positive]), dense(sample[~positive]), float(np.clip(prior, 1e-3, 0.9)))
    return Model(index, w, b)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1); null and empty texts score as texts without any feature. Repeated rows score alike. A column score is
    replaced; other columns stay. Empty table: no rows."""
    docs = docs.drop("score")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bytes] = {}
        for b in batches:
            out = np.empty(len(b))
            for k, text in enumerate(b["text"].array):
                i, v = _vector(model.features, known, text)
                g = model.bias + float(model.weight[i] @ v)
                out[k] = 1 / (1 + np.exp(-min(max(g, -30.0), 30.0)))
            yield b.assign(score=out)
        known.clear()
        trim()

    return docs.mapInPandas(of, docs.select("*", F.lit(0.0).alias("score")).schema)
