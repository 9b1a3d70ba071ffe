"""Best-fit packing of tokenized documents into sequences of a fixed length, by linear grouping.

Only lengths decide a packing, and there are at most as many as a sequence has tokens. So the plan is made from
the histogram of lengths, whatever the number of documents: large lengths are put in groups of equal cardinality
and rounded up to the group's largest; configurations of the few sizes are optimised by column generation
over a linear program; the groups' actual documents take the configurations' places; small documents are
best-fitted into what is left. A plan is a list of runs: documents of a length, by rank, go to consecutive
sequences at one offset. Ranks are counted in Spark, and each document looks its run up.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import partitions, pinned

CAPACITY = 2048
GROUPS = 512
#: The linear program's solution may exceed its optimum by this part.
GAP = 2e-4
#: Columns that are generated at most, for each size.
ROUNDS = 1
#: Documents of up to this part of a sequence are small.
SMALL_PART = 8
END = 0


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE from a tokenizers JSON file, run by tiktoken, which gives the same ids in a quarter of the time."""
    spec = json.load(open(path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(e: tiktoken.Encoding, text: str) -> np.ndarray:
    if any(s in text for s in e.special_tokens_set):
        return np.array(e.encode(text, allowed_special="all"), np.uint32)
    return np.array(e.encode_ordinary(text), np.uint32)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece of docs (doc_id, text): doc_id, piece (from 0), start, length, ids_crc32 and, with_ids, ids.

    A null text is empty; each document ends in id 0. One of more than capacity ids is cut into pieces of capacity; the first takes the
    remainder. ids_crc32 is of the ids as little-endian unsigned 32-bit numbers.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].array, b["text"].array, strict=True):
                ids = np.append(encode(e, text or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for i, (x, y) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    part = ids[x:y]
                    out.append((None if pd.isna(doc_id) else doc_id, i, x, y - x, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE + (", ids array<long>" if with_ids else ""))


class Plan(NamedTuple):
    """Runs, by length and rank: documents of a length with ranks from rank on go to sequences from bin on, at offset."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    n_bins: int


def best_config(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the greatest value that fits the capacity."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):  # one more document each time
        more, pick = best.copy(), np.full(capacity + 1, -1, np.int32)
        for i, (v, z) in enumerate(zip(value.tolist(), size.tolist(), strict=True)):
            if v > 0 and z <= capacity:
                got = best[: capacity + 1 - z] + v
                better = got > more[z:] + 1e-12
                more[z:][better] = got[better]
                pick[z:][better] = i
        if (pick < 0).all():
            break
        best = more
        picks.append(pick)
    a, c = np.zeros(len(size)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            a[pick[c]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), a


def configurations(size: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that every size has at least need places and few sequences are used."""
    m = len(size)
    basis, inverse, x = np.eye(m), np.eye(m), need.copy()  # each document alone

    def enter(a: np.ndarray, out: int | None = None) -> int:
        """Puts column a into the basis, for the column that it uses up first or for out."""
        nonlocal x
        d = (inverse * a).sum(1)
        if out is None:
            out = int(np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf).argmin())
        basis[:, out] = a
        row = inverse[out] / d[out]
        inverse[:] -= np.outer(d, row)
        inverse[out] = row
        x = (inverse * need).sum(1)
        return out

    # to begin with: the largest size that is left, best filled, until the first of these sizes is used up
    rest, left = need.copy(), np.ones(m, bool)
    for _ in range(m):
        some = np.flatnonzero(left)
        a, room = np.zeros(m), capacity - int(size[some[0]])
        if room >= size[some].min():
            a[some] = best_config(size[some].astype(float), size[some], room)[1]
        a[some[0]] += 1
        ratio = np.where(a > 0, rest / np.where(a > 0, a, 1), np.inf)
        out = int(ratio.argmin())
        rest -= ratio[out] * a
        left[out] = False
        enter(a, out)
    for _ in range(ROUNDS * m):
        value, a = best_config(inverse.sum(0), size, capacity)
        if value <= 1 + GAP:
            break
        enter(a)
    use = np.floor(x + 1e-6).astype(np.int64).clip(0)
    chosen = [(basis[:, i].astype(np.int64), int(use[i])) for i in range(m) if use[i]]
    left = need.astype(np.int64) - sum((a * n for a, n in chosen), np.zeros(m, np.int64))
    while (left > 0).any():  # what rounding down left over: largest first
        a, room = np.zeros(m, np.int64), capacity
        for i in range(m):
            a[i] = max(0, min(left[i], room // size[i]))
            room -= a[i] * size[i]
        n = max(1, int(min(left[i] // a[i] for i in range(m) if a[i])))
        chosen.append((a, n))
        left = left - a * n
    return chosen


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> Plan:
    """counts: documents of each length from 0 to capacity."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    n_bins = int(counts[capacity])
    if n_bins:
        runs.append((capacity, 0, n_bins, 0, 0))
    small = capacity // small_part
    lengths = np.arange(capacity - 1, small, -1)
    have = counts[lengths]
    ends = np.cumsum(have)  # of each length, in the order from the largest
    n_large = int(ends[-1]) if len(ends) else 0
    if n_large:
        at = np.unique(np.arange(groups) * n_large // groups)
        sizes = lengths[np.searchsorted(ends, at, side="right")]
        first = np.unique(sizes, return_index=True)[1][::-1]  # groups rounded to one size are one
        size, start = sizes[first], at[first]
        need = np.diff([*start, n_large])
        left, spot = need.copy(), start.copy()
        for a, n in configurations(size, need.astype(float), capacity):
            slots = [(i, int(min(n, left_i))) for i in np.flatnonzero(a) for left_i in _shares(left, i, int(a[i]), n)]
            edges, places = {0, n}, []
            for i, have_i in slots:
                lo = int(spot[i])
                spot[i] += have_i
                if have_i:
                    inner = ends[(ends > lo) & (ends < lo + have_i)] - lo
                    edges.update(int(v) for v in inner)
                    edges.add(have_i)
                    places.append((lo, have_i))
            cuts = sorted(edges)
            for x, y in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for lo, have_i in places:
                    if x < have_i:
                        j = int(np.searchsorted(ends, lo + x, side="right"))
                        runs.append((int(lengths[j]), lo + x - int(ends[j] - have[j]), y - x, n_bins + x, offset))
                        offset += int(lengths[j])
                gaps[capacity - offset].append((n_bins + x, y - x))
            n_bins += n
    for length in range(min(small, capacity - 1), 0, -1):
        n, rank = int(counts[length]), 0
        for room in range(length, capacity + 1):
            while n and gaps[room]:
                b, c = gaps[room].pop()
                each = room // length
                whole = min(c, n // each)
                if whole < c:  # the rest of the sequences stay, one of them with what remains
                    part = n - whole * each if whole * each < n else 0
                    spare = whole + bool(part)
                    if spare < c:
                        gaps[room].append((b + spare, c - spare))
                    for t in range(part):
                        runs.append((length, rank + whole * each + t, 1, b + whole, capacity - room + t * length))
                    if part:
                        gaps[room - part * length].append((b + whole, 1))
                    n -= part
                for t in range(each if whole else 0):
                    runs.append((length, rank + t * whole, whole, b, capacity - room + t * length))
                if whole:
                    gaps[room - each * length].append((b, whole))
                rank = int(counts[length]) - (n - whole * each)
                n -= whole * each
        if n:
            each = capacity // length
            whole, part = divmod(n, each)
            for t in range(each if whole else 0):
                runs.append((length, rank + t * whole, whole, n_bins, t * length))
            for t in range(part):
                runs.append((length, rank + whole * each + t, 1, n_bins + whole, t * length))
            if whole:
                gaps[capacity - each * length].append((n_bins, whole))
            if part:
                gaps[capacity - part * length].append((n_bins + whole, 1))
            n_bins += whole + bool(part)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*table.T, n_bins)


def _shares(left: np.ndarray, i: int, times: int, n: int) -> list[int]:
    """What each of a configuration's times places for size i can have of the documents left, n at most."""
    out = []
    for _ in range(times):
        out.append(int(min(n, left[i])))
        left[i] -= out[-1]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (with doc_id, piece, length) with columns sequence_id and offset; pieces of one sequence follow one another from 0 without gaps.

    Rows with equal doc_id and piece, null ids too, are packed one by one. Other columns stay (those two are replaced, and mf_salt, mf_own, mf_base and mf_rank
    go). A length must be from 0 to capacity. Empty: no rows.
    """
    pieces = pieces.drop("sequence_id", "offset", "mf_salt", "mf_own", "mf_base", "mf_rank")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a length, capacity at most
        counts[r["length"]] = r["n"]
    plan = make_plan(counts, capacity, groups)
    salts = max(64, partitions(pieces.sparkSession), int(counts.sum() // 1_000_000))
    salted = pieces.withColumn("mf_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    held = salted.groupBy("length", "mf_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("mf_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("length", "mf_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mf_base"))
    own = Window.partitionBy("length", "mf_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("mf_own", F.row_number().over(own) - 1).join(base, ["length", "mf_salt"]).withColumn("mf_rank", F.col("mf_base") + F.col("mf_own"))
    key = plan.length * (1 << 48) + plan.rank

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["mf_rank"].to_numpy(np.int64)
            i = np.searchsorted(key, b["length"].to_numpy(np.int64) * (1 << 48) + rank, side="right") - 1
            yield b.drop(columns="mf_rank").assign(sequence_id=plan.bin[i] + rank - plan.rank[i], offset=plan.offset[i])

    rows = ranked.select(*pieces.columns, "mf_rank")
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return rows.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text); see tokenized_pieces and pack."""
    return pack(pinned(tokenized_pieces(docs, capacity, path)), capacity, groups)
