"""Adjacency bit masks of small vertex sets, as Columns and as plain numbers.

Bit T_N[i] + j, for i > j, says that vertices i and j are adjacent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_VERTICES = 8
#: Triangular numbers: where the bits of vertex i begin.
T_N = [n * (n - 1) // 2 for n in range(MAX_VERTICES + 1)]


def bit(i: int, j: int) -> int:
    return T_N[max(i, j)] + min(i, j)


def row_mask(i: int, k: int = MAX_VERTICES) -> int:
    """The bits of all edges of vertex i among k vertices."""
    return sum(1 << bit(i, j) for j in range(k) if j != i)


def connect(mask: Column, i: int, j: int, present: Column | None = None) -> Column:
    put = mask.bitwiseOR(F.lit(1 << bit(i, j)))
    return put if present is None else F.when(present, put).otherwise(mask)


def has(mask: Column, i: int, j: int) -> Column:
    return F.getbit(mask, F.lit(bit(i, j))) == 1


def n_edges(mask: Column) -> Column:
    return F.bit_count(mask)


def degree(mask: Column, i: int, k: int = MAX_VERTICES) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(row_mask(i, k))))


def old_degree(mask: Column, new: Column, i: int, k: int = MAX_VERTICES) -> Column:
    """Of the edges that aren't new."""
    return degree(mask.bitwiseXOR(new), i, k)


def truncate(vertices: Column, mask: Column, k: int) -> tuple[Column, Column]:
    """The first k vertices and their mask."""
    return F.slice(vertices, 1, k), mask.bitwiseAND(F.lit((1 << T_N[k]) - 1))


def complete(mask: Column, k: int) -> Column:
    return mask == F.lit((1 << T_N[k]) - 1)


def degree_id(mask: Column, k: int) -> Column:
    """The degrees in ascending order, two bits each, the least first and highest; for k up to 4."""
    degrees = F.array_sort(F.array(*(degree(mask, i, k) for i in range(k))))
    return F.aggregate(degrees, F.lit(0), lambda acc, d: acc * 4 + d)


def describe(vertices: Column, mask: Column, new: Column, k: int) -> Column:
    """A line for people: the vertices and the edges, each new or old."""
    edges = [F.when(has(mask, i, j), F.concat(vertices[j], F.lit("-"), vertices[i], F.when(has(new, i, j), " new").otherwise(" old"))) for j, i in combinations(range(k), 2)]
    return F.concat(F.lit("["), F.array_join(vertices.cast("array<string>"), " "), F.lit("] "), F.array_join(F.array_compact(F.array(*edges)), ", "))


def _connected(mask: int, k: int) -> bool:
    seen, todo = {0}, [0]
    while todo:
        i = todo.pop()
        for j in range(k):
            if j != i and mask >> bit(i, j) & 1 and j not in seen:
                seen.add(j)
                todo.append(j)
    return len(seen) == k


@lru_cache(maxsize=1 << 16)
def canonical_order(mask: int, k: int) -> tuple[tuple[int, ...], int] | None:
    """Of k vertices in ascending order, connected by mask: the positions in the order in which the enumeration reaches them (see expand.canonical), and the mask in that order. None if they aren't connected."""
    adjacent = lambda i, j: mask >> bit(i, j) & 1

    def extend(order: tuple[int, ...]) -> tuple[int, ...] | None:
        if len(order) == k:
            return order
        for c in range(1, k):
            first = next((i for i, v in enumerate(order) if c not in order and adjacent(v, c)), None)
            if first is not None and all(v < c for v in order[first + 1 :]) and (found := extend((*order, c))):
                return found
        return None

    order = extend((0,))
    return order and (order, sum(1 << bit(i, j) for i in range(k) for j in range(i) if adjacent(order[i], order[j])))


#: Up to so many vertices all masks are listed; of more, those that occur.
LISTED = 5


@lru_cache
def patterns(k: int) -> list[tuple[int, bool, int]]:
    """(mask, connected, pattern id) of every mask of k vertices, k up to LISTED. The id is the degree id for k up to 4, else the least mask of all permutations."""
    if k > LISTED:
        raise ValueError(f"the masks of {k} vertices are too many to list")
    every = np.arange(1 << T_N[k])
    return [(int(m), _connected(int(m), k), int(n)) for m, n in zip(every, pattern_ids(every, k), strict=True)]


def pattern_ids(some: np.ndarray, k: int) -> np.ndarray:
    """The pattern id of each mask of k vertices."""
    if k <= 4:
        degrees = np.sort(np.stack([np.bitwise_count(some & row_mask(i, k)) for i in range(k)], 1).astype(np.int64), 1)
        return degrees @ (4 ** np.arange(k - 1, -1, -1))
    # the bits of all permutations of a mask are a matrix product; doubles hold 28 bits exactly
    weight = np.array([[float(1 << bit(p[i], p[j])) for i in range(k) for j in range(i)] for p in permutations(range(k))]).T
    bits = (some[:, None] >> np.arange(T_N[k]) & 1).astype(float)
    return np.concatenate([(bits[i : i + 256] @ weight).min(1) for i in range(0, len(some), 256)] or [np.empty(0)]).astype(np.int64)


def pattern_table(spark: SparkSession, k: int) -> DataFrame:
    """patterns(k) as a table of 2^(k(k-1)/2) rows, small enough to broadcast."""
    return spark.createDataFrame(patterns(k), "mask int, connected boolean, pattern_id int")


def occurring(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """(mask, connected, pattern_id) of every mask in the columns of rows. Up to LISTED vertices that is all masks, else rows should be pinned."""
    if k <= LISTED:
        return F.broadcast(pattern_table(rows.sparkSession, k))
    some = None
    for c in columns:
        one = rows.select(F.col(c).alias("mask"))
        some = one if some is None else some.unionByName(one)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b["mask"].to_numpy(np.int64)
            yield pd.DataFrame({"mask": m, "connected": [_connected(int(x), k) for x in m], "pattern_id": pattern_ids(m, k)})

    return some.distinct().mapInPandas(name, "mask int, connected boolean, pattern_id int")


def orders(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """(mask, order, in_order) of every connected mask in the columns of rows: canonical_order."""
    schema = "mask int, order array<int>, in_order int"
    known = lambda m: (lambda x: [(int(m), list(x[0]), x[1])] if x else [])(canonical_order(int(m), k))
    if k <= LISTED:
        return F.broadcast(rows.sparkSession.createDataFrame([r for m in range(1 << T_N[k]) for r in known(m)], schema))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for m in b["mask"] for r in known(m)]
            if found:
                yield pd.DataFrame(found, columns=["mask", "order", "in_order"])

    return occurring(rows, k, *columns).select("mask").mapInPandas(of, schema)
