"""SimHash near-duplicates: fingerprints of word shingles, compared tile by tile.

Distinct fingerprints are laid out by the population counts of their two halves. Two fingerprints within the
radius differ by no more than it in the sum of those counts' differences, so cells that are farther apart
are never paired. What is left is compared exactly in numpy, by exclusive-or and bit counts, in tiles; a pair of tiles
is skipped where the ranges of their quarters' population counts are farther apart than the radius.
A task returns a spanning forest of its links, so copies by the thousand don't become pairs by the million.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.common import WORD, connected_components, partitions, pinned, trim

SEED = 42
#: So many fingerprints meet so many others in one task at most.
BLOCK = 1 << 16
TILE = 512
LOWER = {i: i + 32 for i in range(65, 91)}
_words = re.compile(WORD).findall


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return _words(text.translate(LOWER)) if text else []


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each k-word shingle, repeats included; of the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(joined)]))
    n = len(words) - k + 1
    cuts = map(slice, starts[:n].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of h."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * ones > len(h)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(words: list[str], k: int) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 without words."""
    h = shingle_hashes(words, k)
    if not len(h):
        return 0
    return majority(h)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(words_of(t), k) for t in b["text"].array], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, "doc_id long, fp long")


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _tiles(fp: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    q = quarters(fp)
    return [(i, min(i + TILE, len(fp)), q[i : i + TILE].min(0).astype(int), q[i : i + TILE].max(0).astype(int)) for i in range(0, len(fp), TILE)]


def _sorted(fp: np.ndarray) -> np.ndarray:
    q = quarters(fp)
    return fp[np.lexsort((fp, q[:, 2], q[:, 0]))]


class Forest:
    """Sets of positions, joined by links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def tops(self, i: np.ndarray) -> np.ndarray:
        i = self.root[i]
        while (self.root[i] != i).any():
            i = self.root[i]
        return i

    def join(self, p: int, q: int) -> bool:
        p, q = self.find(p), self.find(q)
        self.root[max(p, q)] = min(p, q)
        return p != q

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins one link for each pair of roots, until none is left."""
        while len(i):
            p, q = self.tops(i), self.tops(j)
            apart = p != q
            i, j = i[apart], j[apart]
            for one in set(zip(p[apart].tolist(), q[apart].tolist(), strict=True)):
                self.join(*one)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """The positions that aren't roots, and their roots."""
        top = self.tops(np.arange(len(self.root)))
        at = np.flatnonzero(top != np.arange(len(top)))
        return at, top[at]


def linked(home: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of the links between home and home or others; all are distinct uint64."""
    home, others = _sorted(home), _sorted(others)
    both = np.concatenate((home, others))
    forest, n = Forest(len(both)), len(home)
    ours, theirs = _tiles(home), _tiles(others)
    for x, (a0, a1, alo, ahi) in enumerate(ours):
        a = home[a0:a1, None]
        for shift, (b0, b1, blo, bhi) in [*((0, t) for t in ours[x:]), *((n, t) for t in theirs)]:
            if np.maximum(0, np.maximum(alo - bhi, blo - ahi)).sum() > radius:
                continue
            near = np.bitwise_count(a ^ both[None, b0 + shift : b1 + shift]) <= radius
            if near.any():
                i, j = near.nonzero()
                forest.join_all(i + a0, j + b0 + shift)
    at, top = forest.moved()
    return both[at], both[top]


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(u, v): fingerprints of distinct (fp, unique) such that the components are those of all links within the radius."""
    spark = distinct.sparkSession
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    placed = distinct.select("fp", high.cast("int").alias("hi"), low.cast("int").alias("lo"))
    count = {(r["hi"], r["lo"]): r["n"] for r in placed.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).collect()}  # 33 x 33 rows at most
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    # each cell's fingerprints in home blocks, and those of the cells around it (its own too, if it has several blocks) in visitor blocks
    grid = []
    for (h, l), n in count.items():
        around = sum(count.get((h + i, l + j), 0) for i, j in steps) - (n if n <= block else 0)
        grid.append((h, l, -(-n // block), max(1, -(-around // block)), n + around))
    if not grid:
        return spark.createDataFrame([], "u long, v long")
    grid = shared_tasks(grid, 2 * block)
    cells = F.broadcast(spark.createDataFrame(grid, "ch int, cl int, n_home int, n_visit int, task int"))
    spread = F.xxhash64("fp")
    home = placed.join(cells, (F.col("hi") == F.col("ch")) & (F.col("lo") == F.col("cl")))
    home = home.select("fp", "ch", "cl", "task", F.pmod(spread, F.col("n_home")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n_visit") - 1)).alias("y"), F.lit(True).alias("home"))
    near = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in steps))
    visit = placed.select("fp", "hi", "lo", F.explode(near).alias("s")).select("fp", "s", (F.col("hi") + F.col("s.i")).alias("vh"), (F.col("lo") + F.col("s.j")).alias("vl"))
    visit = visit.join(cells, (F.col("vh") == F.col("ch")) & (F.col("vl") == F.col("cl"))).where("n_home > 1 or s.i != 0 or s.j != 0")
    visit = visit.select("fp", "ch", "cl", "task", F.explode(F.sequence(F.lit(0), F.col("n_home") - 1)).alias("x"), F.pmod(spread, F.col("n_visit")).cast("int").alias("y"), F.lit(False).alias("home"))

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in b.groupby(["ch", "cl"]):
            fp, own = cell["fp"].to_numpy(np.int64).view(np.uint64), cell["home"].to_numpy(bool)
            out.append(np.stack(linked(fp[own], fp[~own], radius)).view(np.int64))
        u, v = np.concatenate(out, 1)
        return pd.DataFrame({"u": u, "v": v})

    return home.unionByName(visit).groupBy("task", "x", "y").applyInPandas(meet, "u long, v long")


def shared_tasks(grid: list[tuple], most: int) -> list[tuple]:
    """grid rows (..., home blocks, visitor blocks, rows) with a task instead of rows: cells of one block pair share tasks of about as many rows as the
    largest of them has, most at most, so that no task has far more than others; other cells have one of their own."""
    out, task, free = [], 0, []
    single = [g for g in grid if g[-3] == g[-2] == 1]
    size = min(most, max((g[-1] for g in single), default=0))
    for g in sorted(single, key=lambda g: -g[-1]):  # the fullest task that has room; few classes, so few tasks
        at = min((i for i, r in enumerate(free) if r >= g[-1]), key=lambda i: free[i], default=None)
        if at is None:
            at = len(free)
            free.append(max(size, g[-1]))
        free[at] -= g[-1]
        out.append((*g[:-1], at))
    for g in grid:
        if not (g[-3] == g[-2] == 1):
            out.append((*g[:-1], len(free) + task))
            task += 1
    return out


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text); component_id is the smallest doc_id reachable over links
    between fingerprints that differ in at most radius bits.

    Null and empty texts have fingerprint 0, linked like any other. Rows with a null doc_id take part; they get a
    component_id only from rows with one. Repeated rows are all returned. Extra columns are ignored. Empty table: no rows.
    """
    prints = pinned(fingerprints(docs, k))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(least.select("fp"), radius, block))
    grouped = roots.join(least, roots["node"] == least["fp"]).select("node", "component", "rep")
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("low"))
    lowest = grouped.join(lowest, "component").select(F.col("node").alias("fp"), "low")
    ids = pinned(least.join(lowest, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")))
    few = ids.count() <= 100_000  # 16 bytes each
    return prints.join(F.broadcast(ids) if few else ids, "fp").select("doc_id", "fp", "component_id")


#: Texts of one group of candidates whose shingles are in one task at most, twice.
VERIFIED = 1 << 12
#: Bytes of sketches or shingles in one task at most, twice.
HELD = 1 << 26
CHUNK = 512
SKETCH = "doc_id long, n int, odd binary, w1 long, w2 long"


def apart(similarity: float) -> float:
    """Sets of this Jaccard similarity or more differ in at most this share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


@lru_cache(maxsize=1 << 16)
def width(n: int, similarity: float) -> int:
    """Bits of the sketch of n shingles: the least power of two, up to four a shingle, that tells unrelated sets apart by five deviations."""
    bits, most = 128, (n + n / similarity) * apart(similarity)
    while bits < 4 * n:
        share = 0.5 * (1 - np.exp(-4 * n / bits))
        if bits * share - 5 * (bits * share * (1 - share)) ** 0.5 > most:
            break
        bits *= 2
    return bits


def odd_sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is 1 if an odd number of the distinct hashes are i modulo bits; two sketches differ in no more bits than their sets in members."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as they are for fewer bits."""
    return x if x.shape[1] == words else np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)


def digest(words: list[str]) -> np.ndarray:
    """128 bits of the words as two unsigned numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), np.uint64)


def sketches(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of each row of docs (doc_id, text): its number of distinct k-word shingles, their odd sketch and 128 bits of its words."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out, odd = np.zeros((3, len(x)), np.uint64), []
            for row, text in enumerate(x["text"].array):
                words = words_of(text)
                h = np.unique(shingle_hashes(words, k))
                out[:, row] = len(h), *digest(words)
                odd.append(odd_sketch(h, width(len(h), similarity)).tobytes())
            n, w1, w2 = out.view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "n": n, "odd": odd, "w1": w1, "w2": w2})
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, SKETCH)


def near_pairs(n: np.ndarray, odd: list[bytes], home: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, one of them home, whose sizes and sketches allow the similarity: every pair that has it, and few others."""
    order = np.lexsort((n, ~home))
    n, n_home, share = n[order], int(home.sum()), apart(similarity)

    def tile(i: int, j: int) -> tuple:
        rows = [np.frombuffer(odd[at], np.uint64) for at in order[i:j]]
        words = min(map(len, rows))
        return i, j, n[i], n[j - 1], np.concatenate([folded(r[None], words) for r in rows])

    bounds = [(i, min(i + TILE, n_home)) for i in range(0, n_home, TILE)]
    tiles = [tile(i, j) for i, j in [*bounds, *((i, min(i + TILE, len(n))) for i in range(n_home, len(n), TILE))]]
    for x, (i0, i1, nlo, nhi, a) in enumerate(tiles[: len(bounds)]):
        for j0, j1, mlo, mhi, b in tiles[x:]:
            if nhi < similarity * mlo - 1e-9 or mhi < similarity * nlo - 1e-9:
                continue
            words, most = min(a.shape[1], b.shape[1]), (nhi + mhi) * share + 1e-6
            left, right = folded(a, words).T.copy(), folded(b, words).T.copy()
            far = np.zeros((i1 - i0, j1 - j0), np.uint16 if words < 1024 else np.uint32)
            for w in range(words):
                far += np.bitwise_count(left[w][:, None] ^ right[w])
                if 64 * (w + 1) > most and far.min() > most:
                    break
            else:
                i, j = (far <= most).nonzero()
                both = n[i + i0] + n[j + j0]
                good = (far[i, j] <= both * share + 1e-6) & (np.minimum(n[i + i0], n[j + j0]) >= similarity * np.maximum(n[i + i0], n[j + j0]) - 1e-9)
                i, j = i[good] + i0, j[good] + j0
                i, j = i[i < j], j[i < j]
                if len(i):
                    yield order[i], order[j]


def _cells(rows: DataFrame, similarity: float, block: int, each_bytes: float) -> DataFrame:
    """rows (n, id, ...) with the task, cell (to), home block, visitor block and home flag of each place that they go to; similar sizes share a cell.
    A row has about each_bytes a shingle."""
    cell = F.floor(F.log("n") / F.lit(-float(np.log(similarity))) + 1e-9).cast("int")
    placed = rows.withColumn("cell", cell)
    count = {r["cell"]: r["m"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}  # one row for each size class
    most = {c: max(1, min(block, int(HELD / (each_bytes * similarity ** -(c + 2.0))))) for c in count}
    around = lambda c: count.get(c + 1, 0) + (count[c] if count[c] > most[c] else 0)
    grid = [(c, -(-m // most[c]), max(1, -(-around(c) // most[c])), int((m + around(c)) * similarity ** -(c + 2.0))) for c, m in count.items()]  # by shingles
    grid = shared_tasks(grid, int(2 * HELD / each_bytes))
    cells = F.broadcast(rows.sparkSession.createDataFrame(grid, "to int, n_home int, n_visit int, task int"))
    spread = F.xxhash64("id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = placed.join(cells, F.col("cell") == F.col("to"))
    home = own.select(*rows.columns, "to", "task", F.pmod(spread, F.col("n_home")).cast("int").alias("x"), each("n_visit").alias("y"), F.lit(True).alias("home"))
    visits = placed.withColumn("at", F.explode(F.array(F.col("cell"), F.col("cell") - 1))).join(cells, F.col("at") == F.col("to")).where("n_home > 1 or at != cell")
    visit = visits.select(*rows.columns, "to", "task", each("n_home").alias("x"), F.pmod(spread, F.col("n_visit")).cast("int").alias("y"), F.lit(False).alias("home"))
    return home.unionByName(visit)


def _by_cell(rows: DataFrame, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """of each cell of each task."""

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([of(cell.reset_index(drop=True)) for _, cell in b.groupby("to")], ignore_index=True)

    return rows.groupBy("task", "x", "y").applyInPandas(meet, schema)


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, block: int = BLOCK, verified: int = VERIFIED) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text); component_id is the smallest doc_id reachable over pairs of texts whose
    sets of k-word shingles (A-Z lower-cased) have a Jaccard similarity of at least similarity.

    Odd sketches find the candidates by tiled comparison; their shingles decide. Sketches differ in no more bits than the sets in
    shingles, so no pair is left out, whatever its length. Texts of equal words, also of none, are one class. Rows with a null doc_id take part; where
    a component has no other rows its id is null. Repeated rows are all returned; extra columns are ignored. Empty table: no rows.
    """
    rows, found = _classified(docs, k, similarity, block, verified)
    return _with_class(rows, found).select("doc_id", "component_id")


def _classified(docs: DataFrame, k: int, similarity: float, block: int, verified: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and of each class of equal words (_w1, _w2) its component and the least doc_id of that."""
    rows = pinned(sketches(docs, k, similarity))
    same = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.min("n").alias("n"), F.first("odd").alias("odd"))
    # a number of its own for each class: rows of one doc_id may have different texts
    classes = pinned(same.withColumn("id", F.monotonically_increasing_id()))
    if not classes.where("n > 0").take(1):
        near = rows.sparkSession.createDataFrame([], "u long, v long")
    else:
        near = _verified(docs, classes.where("n > 0"), k, similarity, block, verified)
    roots = connected_components(near)
    joined = classes.join(roots, classes["id"] == roots["node"], "left").select("w1", "w2", "low", F.coalesce("component", "id").alias("component"))
    joined = pinned(joined)
    least = joined.groupBy(F.col("component").alias("_c")).agg(F.min("low").alias("component_id"))
    return rows, joined.join(least, F.col("component") == F.col("_c")).select(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"), "component", "component_id")


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")), "left").drop("_w1", "_w2")


def _verified(docs: DataFrame, classes: DataFrame, k: int, similarity: float, block: int, verified: int) -> DataFrame:
    def arrays(x: pd.DataFrame) -> tuple:
        return x["n"].to_numpy(np.int64), x["odd"].tolist(), x["home"].to_numpy(bool)

    def candidates(x: pd.DataFrame) -> pd.DataFrame:
        forest, ids = Forest(len(x)), x["id"].to_numpy(np.int64)
        for i, j in near_pairs(*arrays(x), similarity):
            forest.join_all(i, j)
        at, top = forest.moved()
        return pd.DataFrame({"u": ids[at], "v": ids[top]})

    # texts that candidate pairs join are a group; only within it shingles are compared
    forest = pinned(_by_cell(_cells(classes.select("n", "id", "odd"), similarity, block, 0.5), candidates, "u long, v long"))
    grouped = connected_components(forest).withColumnRenamed("component", "grp")
    chosen = pinned(classes.join(grouped, F.col("id") == F.col("node")).drop("node"))
    total = chosen.agg(F.sum("n")).first()[0] or 0
    n_tasks = max(partitions(docs.sparkSession), int(8.5 * total / HELD) + 1)
    # the rows of a group that one task can't hold go to blocks, and each pair of blocks to a task
    sizes = chosen.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / verified), F.ceil(F.sum("n") * 8.5 / HELD)).cast("int").alias("blocks"))
    lows = pinned(chosen.select("low").distinct())
    few = lows.count() <= 500_000  # 8 bytes each
    lows = lows.withColumnRenamed("low", "_low")
    picked = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(F.broadcast(lows) if few else lows, F.col("low").eqNullSafe(F.col("_low")), "left_semi").select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            w, shingles = np.zeros((len(x), 2), np.uint64), []
            for row, text in enumerate(x["text"].array):  # the words of one text at a time
                words = words_of(text)
                w[row] = digest(words)
                shingles.append(np.unique(shingle_hashes(words, k)).tobytes())
            yield pd.DataFrame({"w1": w[:, 0].view(np.int64), "w2": w[:, 1].view(np.int64), "shingles": shingles})
        trim()

    held = picked.mapInPandas(sets, "w1 long, w2 long, shingles binary").groupBy("w1", "w2").agg(F.min("shingles").alias("shingles"))

    def verify(x: pd.DataFrame) -> list[tuple]:
        ids, shingles = x["id"].to_numpy(np.int64), [np.frombuffer(v, np.uint64) for v in x["shingles"]]
        forest, out = Forest(len(ids)), []
        for left, right in near_pairs(*arrays(x), similarity):
            while len(left):
                open_ = forest.tops(left) != forest.tops(right)  # a pair whose ends are joined already needs no look
                left, right = left[open_], right[open_]
                for i, j in zip(left[:CHUNK].tolist(), right[:CHUNK].tolist(), strict=True):
                    if forest.find(i) != forest.find(j):
                        both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                        if both >= similarity * (len(shingles[i]) + len(shingles[j]) - both) - 1e-9:
                            forest.join(i, j)
                            out.append((ids[i], ids[j]))
                left, right = left[CHUNK:], right[CHUNK:]
        return out

    def each_group(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out = [pair for _, x in b.groupby("grp") for pair in verify(x.reset_index(drop=True))]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    rows = chosen.join(held, ["w1", "w2"]).join(sizes, "grp").select("n", "id", "odd", "shingles", "grp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(n_tasks))).otherwise(F.col("grp"))
    rows = rows.select("n", "id", "odd", "shingles", "grp", (F.col("blocks") > 1).alias("large"), task.alias("task"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("home"))
    return rows.groupBy("large", "task", "x", "y").applyInPandas(each_group, "u long, v long")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar_documents: that of the smallest doc_id (nulls last), of equal ids the first by text (nulls as empty).
    Rows of one doc_id, or of none, with texts that aren't similar are apart. Other columns stay. Empty table: no rows."""
    rows, found = _classified(docs, k, similarity, BLOCK, VERIFIED)
    found = pinned(found)
    each = pinned(_with_class(rows, found).select("doc_id", "component_id"))
    ids = each.where("doc_id is not null")
    many = pinned(ids.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_many")))
    gone = ids.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).unionByName(many.select(F.col("_many").alias("_gone"))).distinct()
    gone = pinned(gone)
    known = docs.where("doc_id is not null")
    kept = known.join(F.broadcast(gone) if gone.count() <= 500_000 else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    n_many, none = many.count(), docs.where("doc_id is null")
    if not n_many and not each.where("doc_id is null").take(1):
        return kept

    @F.pandas_udf("w1 long, w2 long")
    def words_digest(texts: pd.Series) -> pd.DataFrame:
        w = np.array([digest(words_of(t)) for t in texts.array], np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"w1": w[:, 0], "w2": w[:, 1]})

    again = known.join(F.broadcast(many) if n_many <= 500_000 else many, F.col("doc_id") == F.col("_many"), "left_semi").unionByName(none)
    again = again.select(F.struct(*docs.columns).alias("_row"), words_digest("text").alias("_d"))
    again = again.join(found, (F.col("_d.w1") == F.col("_w1")) & (F.col("_d.w2") == F.col("_w2"))).where(F.col("_row.doc_id").eqNullSafe(F.col("component_id")))
    # combined before the shuffle, however many rows a component has
    first = again.groupBy("component").agg(F.min_by("_row", F.coalesce("_row.text", F.lit(""))).alias("_row"))
    return kept.unionByName(first.select("_row.*"))
