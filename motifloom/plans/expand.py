"""Plan builders for subgraph enumeration: each level is one join with a table of neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import masks
from motifloom.graph import Graph
from motifloom.plans.cut import pinned, shared_folder, small, swept

Predicate = Callable[[list[Column], Column], Column]


def clique_levels(g: Graph, k: int, accept: Predicate | None = None) -> DataFrame:
    """Rows v0..v(k-2) and cand: the vertices that complete a k-clique.

    Vertices come in the order of (degree, id), so each clique is found once and candidate lists stay short: the level adds a vertex and
    intersects its list with the candidates, by one join. accept(vertices, new) keeps a candidate; the last level's are filtered too.
    """
    if not 2 <= k <= masks.MAX_VERTICES:
        raise ValueError(f"k is {k}; it must be from 2 to {masks.MAX_VERTICES}")
    out = g.oriented()
    ok = lambda vs, c: F.filter(c, lambda x: accept(vs, x)) if accept else c
    rows = out.select(F.col("v").alias("v0"), F.col("out").alias("cand"))
    rows = rows.withColumn("cand", ok([F.col("v0")], F.col("cand")))
    for i in range(1, k - 1):
        need = k - i
        rows = rows.where(F.size("cand") >= need).withColumn(f"v{i}", F.explode("cand"))
        rows = rows.join(out.select(F.col("v").alias(f"v{i}"), "out"), f"v{i}")
        vs = [F.col(f"v{j}") for j in range(i + 1)]
        rows = rows.select(*vs, ok([F.col(f"v{i}")], F.array_intersect("cand", "out")).alias("cand"))
    return rows.where(F.size("cand") > 0)


def cliques(g: Graph, k: int, accept: Predicate | None = None) -> DataFrame:
    """(vertices): each k-clique once, in ascending order."""
    rows = clique_levels(g, k, accept)
    vs = [F.col(f"v{j}") for j in range(k - 1)]
    return rows.withColumn("_last", F.explode("cand")).select(F.array_sort(F.array(*vs, F.col("_last"))).alias("vertices"))


def n_cliques(g: Graph, k: int, accept: Predicate | None = None) -> DataFrame:
    """(found): the last level is counted, not made."""
    return clique_levels(g, k, accept).agg(F.coalesce(F.sum(F.size("cand").cast("long")), F.lit(0)).cast("long").alias("found"))


def canonical(vs: list[Column], adjacent: list[Column], c: Column) -> Column:
    """After the first vertex that c is adjacent to, none of the set's vertices is larger than c. So each set is reached in one order."""
    test = F.lit(False)
    for i in reversed(range(len(vs))):
        later = F.lit(True)
        for v in vs[i + 1 :]:
            later = later & (v < c)
        test = F.when(adjacent[i], later).otherwise(test)
    return test


#: Neighbours of a vertex that lie in one row at most.
HUB = 20_000


def induced(g: Graph, k: int, pfilter: Predicate | None = None, keep: Callable[[list[Column], Column], Column] | None = None, lists: bool | None = None) -> DataFrame:
    """v0..v(k-1), mask: each connected induced subgraph of k vertices once.

    Seeds are the edges; a candidate is larger than v0, a neighbour of some vertex and passes canonical(). pfilter(vertices, candidate)
    is applied before a vertex is added; keep(vertices, mask) after, and must be anti-monotone. With lists each row carries its vertices'
    neighbours; without, candidates are rows. By default that depends on whether a vertex has more than HUB neighbours.
    """
    if k > 2 and lists is None:
        g = Graph(pinned(g.edges.select("src", "dst")))
        lists = (g.degree().agg(F.max("degree")).first()[0] or 0) <= HUB
    if k > 2 and not lists:
        return _induced_by_edges(g, k, pfilter, keep)
    nb = g.adjacency()
    of = lambda i: nb.select(F.col("v").alias(f"v{i}"), F.col("nb").alias(f"n{i}"))
    rows = g.edges.select(F.col("src").alias("v0"), F.col("dst").alias("v1"), F.lit(1).alias("mask"))
    if pfilter:
        rows = rows.where(pfilter([], F.col("v0"))).where(pfilter([F.col("v0")], F.col("v1")))
    if keep:
        rows = rows.where(keep([F.col("v0"), F.col("v1")], F.col("mask")))
    if k > 2:
        rows = rows.join(of(0), "v0").withColumn("n0", F.filter("n0", lambda x: x > F.col("v0")))
    for i in range(2, k):
        rows = rows.join(of(i - 1), f"v{i - 1}").withColumn(f"n{i - 1}", F.filter(f"n{i - 1}", lambda x: x > F.col("v0")))
        vs = [F.col(f"v{j}") for j in range(i)]
        lists = [F.col(f"n{j}") for j in range(i)]
        every = lists[0]
        for x in lists[1:]:
            every = F.array_union(every, x)
        c = F.col("c")
        rows = rows.withColumn("c", F.explode(F.array_except(every, F.array(*vs))))
        rows = rows.withColumn("adj", F.array(*(F.array_contains(x, c) for x in lists)))
        adjacent = [F.col("adj")[j] for j in range(i)]
        rows = rows.where(canonical(vs, adjacent, c))
        if pfilter:
            rows = rows.where(pfilter(vs, c))
        mask = F.col("mask")
        for j in range(i):
            mask = mask.bitwiseOR(F.when(adjacent[j], F.lit(1 << masks.bit(i, j))).otherwise(F.lit(0)))
        last = i == k - 1
        rows = rows.select(*vs, c.alias(f"v{i}"), mask.cast("int").alias("mask"), *([] if last else lists))
        if keep:
            rows = rows.where(keep([*vs, F.col(f"v{i}")], F.col("mask")))
    return rows.select(*(f"v{j}" for j in range(k)), "mask")


#: Candidates that the sets of a slice of induced_counts() look at, about.
SLICE_ROWS = 500_000_000


def induced_counts(g: Graph, k: int, slice_rows: int = SLICE_ROWS, hub: int = HUB) -> DataFrame:
    """(mask, n): how many sets induced() has of each mask, whatever the hubs. Sets are made in slices by a hash of their first edge, each counted
    and its shuffles' files removed before the next, so that the disk holds the rows of a slice, whatever the graph."""
    g = Graph(pinned(g.edges.select("src", "dst")))
    least, last = g.edges.agg(F.min("src"), F.max("dst")).first()
    if least is not None and last - least < 1 << 31:  # shorter lists, in the same order
        g = Graph(g.edges.select(*((F.col(x) - F.lit(least)).cast("int").alias(x) for x in ("src", "dst"))))
    # walks of k vertices, about: each is a set of one vertex less and a candidate
    of = g.degree().agg(F.coalesce(F.sum(F.pow("degree", F.lit(k - 1))), F.lit(0.0)).alias("walks"), F.coalesce(F.max("degree"), F.lit(0)).alias("most")).first()
    n, parts = max(1, math.ceil(of["walks"] / slice_rows)), max(1, math.ceil(of["most"] / hub))
    nb = g.symmetric().groupBy("v", F.pmod(F.xxhash64("u"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list("u")).alias("nb"))
    nb = pinned(nb) if k > 2 else nb
    folder = shared_folder(g.edges.sparkSession, "induced")
    for i in range(n):
        seeds = g.edges.where(F.pmod(F.xxhash64("src", "dst"), F.lit(n)) == i)
        rows = _induced_in_parts(nb, parts, k, seeds)
        with swept(g.edges.sparkSession):
            rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/slice={i}")
    return g.edges.sparkSession.read.schema("mask int, n long").parquet(f"{folder}/*").groupBy("mask").agg(F.sum("n").alias("n"))


def _induced_in_parts(nb: DataFrame, parts: int, k: int, seeds: DataFrame) -> DataFrame:
    """induced() of the sets that begin with an edge of seeds. nb (v, part, nb): each vertex's neighbours in parts by a hash of theirs.

    A set meets its vertices' neighbours one part at a time, so no row grows with a hub. What is adjacent to a candidate is in the candidate's part,
    so candidates become rows where their set lies, and only sets are shuffled: once a level, to the neighbours of the vertex that came last.
    """
    by = ["part"] if parts > 1 else []  # one part: a key of one number
    of = lambda i: nb.select(F.col("v").alias(f"v{i}"), *by, F.col("nb").alias(f"n{i}")).hint("shuffle_hash")
    some = lambda n, of: F.coalesce(of, F.array().cast(nb.schema["nb"].dataType)).alias(n)
    above = lambda n: some(n, F.filter(n, lambda x: x > F.col("v0")))
    rows = seeds.select(F.col("src").alias("v0"), F.col("dst").alias("v1"), F.lit(1).alias("mask"))
    if k > 2:
        rows = rows.select("*", *(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(x) for x in by))
        rows = rows.join(of(0), ["v0", *by], "left").select("v0", "v1", "mask", *by, above("n0"))
    for i in range(2, k):
        vs, names = [f"v{j}" for j in range(i)], [f"n{j}" for j in range(i)]
        rows = rows.join(of(i - 1), [f"v{i - 1}", *by], "left")
        # lists that travel on are cut to what is larger than v0
        rows = rows.select(*vs, "mask", *by, *names[:-1], above(names[-1]) if i < k - 1 else some(names[-1], F.col(names[-1])))
        if i < k - 1:
            rows = rows.sortWithinPartitions(f"v{i - 1}")  # rows that have a list in common are written one after another, and packed
        met = rows.select(*vs, "mask", *by, *names, F.posexplode(F.concat(*names)).alias("pos", "c"))
        pos, c, ends = F.col("pos"), F.col("c"), [F.size(names[0])]
        for x in names[1:]:
            ends.append(ends[-1] + F.size(x))
        # a candidate is taken from the first list that has it, if none of the vertices after that list's is larger (see canonical)
        test, mask = F.lit(True), F.col("mask")
        for j in reversed(range(i)):
            here = F.lit(True)
            for v in vs[j + 1 :]:
                here = here & (F.col(v) < c)
            for x in names[:j]:
                here = here & ~F.array_contains(x, c)
            test = here if j == i - 1 else F.when(pos < ends[j], here).otherwise(test)
        for j in range(i):
            adjacent = pos < ends[0] if j == 0 else F.when(pos >= ends[j - 1], pos < ends[j]).otherwise(F.array_contains(names[j], c))
            mask = mask.bitwiseOR(F.when(adjacent, F.lit(1 << masks.bit(i, j))).otherwise(F.lit(0)))
        met = met.where((c > F.col("v0")) & ~c.isin(*(F.col(v) for v in vs[1:]))).where(test)
        new = [*vs, c.alias(f"v{i}"), mask.alias("mask")]
        if i == k - 1:
            rows = met.select(*new)
        elif parts == 1:
            rows = met.select(*new, *names)
        else:
            # the set's neighbours in the other parts
            rows = met.select(*new).join(rows.select(*vs, *by, *names), vs).select(*vs, f"v{i}", "mask", *by, *names)
    return rows.select(*(f"v{j}" for j in range(k)), "mask")


def _induced_by_edges(g: Graph, k: int, pfilter: Predicate | None, keep: Callable[[list[Column], Column], Column] | None) -> DataFrame:
    """induced, where a level joins each vertex of a set with its edges and the rows of one candidate are put together: no row is longer than the set."""
    sym = g.symmetric()
    rows = g.edges.select(F.col("src").alias("v0"), F.col("dst").alias("v1"), F.lit(1).alias("mask"))
    if pfilter:
        rows = rows.where(pfilter([], F.col("v0"))).where(pfilter([F.col("v0")], F.col("v1")))
    if keep:
        rows = rows.where(keep([F.col("v0"), F.col("v1")], F.col("mask")))
    for i in range(2, k):
        vs = [F.col(f"v{j}") for j in range(i)]
        each = F.array(*(F.struct(v.alias("v"), F.lit(1 << masks.bit(i, j)).alias("b")) for j, v in enumerate(vs)))
        met = rows.select(*vs, "mask", F.explode(each).alias("x")).select(*vs, "mask", "x.v", "x.b").join(sym.withColumnRenamed("u", "c"), "v").where((F.col("c") > vs[0]) & ~F.col("c").isin(*vs[1:])).drop("v")
        if pfilter:
            met = met.where(pfilter(vs, F.col("c")))
        # nothing meets before the shuffle, so no table of groups is made there
        met = met.repartition(*vs, "c").groupBy(*vs, "mask", "c").agg(F.bit_or("b").alias("b"))
        adjacent = [F.col("b").bitwiseAND(F.lit(1 << masks.bit(i, j))) != 0 for j in range(i)]
        rows = met.where(canonical(vs, adjacent, F.col("c"))).select(*vs, F.col("c").alias(f"v{i}"), F.col("mask").bitwiseOR(F.col("b")).cast("int").alias("mask"))
        if keep:
            rows = rows.where(keep([*vs, F.col(f"v{i}")], F.col("mask")))
    return rows


def grow(neighbours: DataFrame, sets: DataFrame, accept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(vertices): every set of sets with one neighbour more, once, in ascending order. neighbours: (v, u) in both directions."""
    rows = sets.select("vertices", F.explode("vertices").alias("v")).join(neighbours, "v").where(~F.array_contains("vertices", F.col("u")))
    if accept:
        rows = rows.where(accept(F.col("vertices"), F.col("u")))
    return rows.select(F.array_sort(F.array_append("vertices", F.col("u"))).alias("vertices")).distinct()


def near(neighbours: DataFrame, sets: DataFrame, ends: tuple[str, ...] = ("v",)) -> DataFrame:
    """The rows of neighbours with ends in vertices of sets (pinned), found without a shuffle of neighbours where those are few."""
    vs = small(pinned(sets.select(F.explode("vertices").alias("_v")).distinct()))
    for end in ends:
        neighbours = neighbours.join(vs, F.col(end) == F.col("_v"), "left_semi")
    return neighbours


def with_masks(sets: DataFrame, k: int, **graphs: DataFrame) -> DataFrame:
    """sets (vertices, distinct, pinned) with a mask column (0: no edge) for each given table of edges (src, dst). Only the edges among the sets' vertices are shuffled."""
    pairs = F.array(*(F.struct(F.col("vertices")[j].alias("src"), F.col("vertices")[i].alias("dst"), F.lit(1 << masks.bit(i, j)).alias("b")) for i in range(k) for j in range(i)))
    rows = sets.select("vertices", F.explode(pairs).alias("p")).select("vertices", "p.src", "p.dst", "p.b")
    every = None
    for name, e in graphs.items():
        one = e.select("src", "dst", F.lit(1 << list(graphs).index(name)).alias("g"))
        every = one if every is None else every.unionByName(one)
    every = near(every, sets, ("src", "dst")).groupBy("src", "dst").agg(F.bit_or("g").alias("g"))
    rows = rows.join(every, ["src", "dst"], "left").groupBy("vertices")
    return rows.agg(*(F.bit_or(F.when(F.getbit(F.coalesce("g", F.lit(0)), F.lit(n)) == 1, F.col("b")).otherwise(0)).alias(name) for n, name in enumerate(graphs)))
