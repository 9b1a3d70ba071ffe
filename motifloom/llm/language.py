"""Language identification by the nearest centroid.

A text's vector has the TF-IDF weights of its letter n-grams (1 to 3, hashed), of length 1. Each language has several
centroids, clustered by spherical k-means from a bounded sample of labelled texts. The language of the centroid of the
greatest cosine is predicted; a text that is farther from it than nearly all of the language's sample is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import pinned

DIMENSIONS = 4096
#: So many distinct texts at most (one a language at least) are the sample that centroids are fitted on, in equal parts by language.
SAMPLE = 4_000
CENTROIDS = 4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the text's lower-cased letters, other characters being one space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    table = letter_table()
    letter = table[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    c = np.concatenate((np.array([32], np.uint64), c[keep], np.array([32][: int(letter[-1])], np.uint64)))
    k = np.uint64(0x9E3779B97F4A7C15)
    put = lambda h: ((h * k) >> np.uint64(52)).astype(np.int64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((two[:-1] << np.uint64(21)) | c[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    one = c[c != 32]
    return np.bincount(np.concatenate((put(one), put(two ^ (two >> np.uint64(20))), put(three ^ (three >> np.uint64(29))))), minlength=DIMENSIONS)


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # the cosine under which a text is rejected, of each centroid


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids at most of unit vectors, by spherical k-means from farthest first points."""
    start = [int((x @ x.mean(0)).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, reject_part: float = 0.01) -> Model:
    """A model from docs (text, lang); null texts and langs, and texts without a letter, are left out. Document frequencies are of
    all rows, centroids of the sample: at most sample distinct texts (one a language at least), those of the least hashes, so that
    copies of a text are one. reject_part of a language's sample would be rejected. No row to learn from: a model without a language.
    Extra columns are ignored."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    each = max(1, sample // max(1, rows.select("lang").distinct().count()))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The documents with each n-gram, all documents at -1, and each language's least hashes of distinct texts."""
        df, n, least = np.zeros(DIMENSIONS, np.int64), 0, {}
        for b in batches:
            for lang, h, text in zip(b["lang"].array, b["h"].to_numpy(), b["text"].array, strict=True):
                c = gram_counts(text)
                if c is None:
                    continue
                df += c > 0
                n += 1
                least.setdefault(lang, set()).add(int(h))
            least = {lang: set(sorted(hs)[:each]) for lang, hs in least.items()}
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"i": np.arange(-1, DIMENSIONS), "n": np.append(n, df), "lang": None, "h": 0, "task": task})
        yield pd.DataFrame([(-2, 0, lang, h, task) for lang, hs in least.items() for h in hs], columns=["i", "n", "lang", "h", "task"])

    told = pinned(rows.mapInPandas(tally, "i int, n long, lang string, h long, task int"))
    total = {r["i"]: r["n"] for r in told.where("i >= -1").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # DIMENSIONS rows and one
    if not total.get(-1):
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    idf = np.log((1 + total[-1]) / (1 + np.array([total[i] for i in range(DIMENSIONS)]))).astype(np.float32) + 1
    chosen = told.where("i = -2").select("lang", "h", "task")
    for groups in (4096, 256, 16, 1):  # the least of some tasks, then of some of these groups: no group grows with the number of tasks
        chosen = chosen.select("lang", "h", F.pmod("task", F.lit(groups)).alias("task")).distinct()
        first = Window.partitionBy("lang", "task").orderBy("h")
        chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).drop("place")
    picked = rows.join(F.broadcast(pinned(chosen.select("lang", "h"))), ["lang", "h"])  # each texts a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for b in batches:
            got = []
            for lang, h, text in zip(b["lang"].array, b["h"].to_numpy(), b["text"].array, strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    c = gram_counts(text)
                    at = np.flatnonzero(c)
                    got.append((lang, h, at.astype(np.int16), c[at].astype(np.int32)))
            if got:  # an empty frame has no type for its lists
                yield pd.DataFrame(got, columns=["lang", "h", "i", "c"])

    got = picked.mapInPandas(count, "lang string, h long, i array<smallint>, c array<int>").dropDuplicates(["lang", "h"]).toPandas()
    got = got.sort_values(["lang", "h"])
    counts = np.zeros((len(got), DIMENSIONS), np.int32)
    for row, (i, c) in enumerate(zip(got["i"], got["c"], strict=True)):
        counts[row, np.asarray(i, np.int64)] = c
    x, lang = vectors(counts, idf), got["lang"].to_numpy()
    langs, cents, least = [], [], []
    for one in sorted(set(lang)):
        own = x[lang == one]
        c = cluster(own, centroids)
        bound = float(np.quantile((own @ c.T).max(1), reject_part))
        langs += [one] * len(c)
        cents.append(c)
        least += [bound] * len(c)
    return Model(langs, np.concatenate(cents).astype(np.float32), idf, np.array(least))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns nearest (the language of the nearest centroid), lang_score (its cosine), rejected (bool) and lang_pred (nearest, or und where rejected).

    A null text, or one without a letter, has nearest und, lang_score 0 and rejected true; so have all texts if the model
    has no language. Of languages with equal cosines the first by name is predicted. Repeated rows are all returned; columns of
    these names are replaced. Empty table: no rows.
    """
    docs = docs.drop("nearest", "lang_score", "rejected", "lang_pred")
    names = np.array([*model.langs, UNKNOWN], object)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best, score = np.full(len(b), -1), np.zeros(len(b))
            texts = b["text"].array
            for at in range(0, len(b), 128):
                counts = [gram_counts(t) for t in texts[at : at + 128]]
                rows = np.array([i for i, c in enumerate(counts) if c is not None], np.int64)
                if len(rows) and len(model.langs):
                    cos = vectors(np.stack([counts[i] for i in rows]), model.idf) @ model.centroids.T
                    best[at + rows], score[at + rows] = cos.argmax(1), cos.max(1)
            rejected = (best < 0) | (score < np.append(model.least, np.inf)[best])
            yield b.assign(nearest=names[best], lang_score=np.clip(score, 0, 1), rejected=rejected, lang_pred=np.where(rejected, UNKNOWN, names[best]))

    schema = docs.select("*", F.lit("").cast("string").alias("nearest"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("rejected"), F.lit("").cast("string").alias("lang_pred")).schema
    return docs.mapInPandas(of, schema)
