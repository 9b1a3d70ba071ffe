"""The mining queries: cliques, triangles, motifs, label-distinct cliques, keyword search and patterns of one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import masks
from motifloom.graph import Graph, id_of, label_of
from motifloom.plans import expand
from motifloom.plans.cut import pinned

KEYWORDS = 3


def colour(v: Column, k: int) -> Column:
    return F.pmod(v, F.lit(k))


def keyword_label(v: Column) -> Column:
    return v.bitwiseAND(F.lit(31))


def kclique_count(g: Graph, k: int) -> DataFrame:
    """(found)"""
    return expand.n_cliques(g, k)


def kclique_list(g: Graph, k: int) -> DataFrame:
    """v0 < v1 < ... of each clique."""
    return expand.cliques(g, k).select(*(F.col("vertices")[i].alias(f"v{i}") for i in range(k)))


def color_clique_count(g: Graph, k: int, colours: int | None = None, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """(found): k-cliques whose labels all differ: g's own if it has a table of labels, else id modulo colours (k if not given). Labels are compared as soon as a vertex is added."""
    if g.labels is not None and not label:
        g, label = g.labelled(), label_of
        # edges within a label are in no such clique, nor are vertices without one
        g = Graph(g.edges.where((label_of(F.col("src")) != label_of(F.col("dst"))) & (label_of(F.col("src")) >= 0) & (label_of(F.col("dst")) >= 0)))
        return expand.n_cliques(g, k)
    of = label or (lambda v: colour(v, colours or k))
    return expand.n_cliques(g, k, lambda vs, c: of(vs[-1]) != of(c) if len(vs) == 1 else F.lit(True))


def triangles(g: Graph) -> DataFrame:
    """a < b < c"""
    return kclique_list(g, 3).toDF("a", "b", "c")


def triangles_per_vertex(g: Graph) -> DataFrame:
    return triangles(g).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("triangles"))


def triangles_per_edge(g: Graph) -> DataFrame:
    pairs = F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ac", "bc")))
    return triangles(g).select(F.explode(pairs).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("triangles"))


def clique4_from_triangles(g: Graph) -> DataFrame:
    """(found): 4-cliques composed of stored triangles: abc and abd, with acd closing, meet on shared pairs."""
    t = triangles(g)
    abd, acd = t.select("a", "b", F.col("c").alias("d")), t.select("a", F.col("b").alias("c"), F.col("c").alias("d"))
    bcd = t.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"))
    both = t.join(abd, ["a", "b"]).where("c < d")
    return both.join(acd, ["a", "c", "d"], "left_semi").join(bcd, ["b", "c", "d"], "left_semi").agg(F.count(F.lit(1)).alias("found"))


def motif_census(g: Graph, k: int) -> DataFrame:
    """(pattern_id, cnt): connected induced subgraphs of k vertices, k up to masks.MAX_VERTICES, by pattern, by enumeration."""
    if not 2 <= k <= masks.MAX_VERTICES:
        raise ValueError(f"k is {k}; it must be from 2 to {masks.MAX_VERTICES}")
    rows = expand.induced(g, k)
    if k <= 4:
        return rows.groupBy(masks.degree_id(F.col("mask"), k).alias("pattern_id")).agg(F.count(F.lit(1)).alias("cnt"))
    # few masks are named, whatever the sets: those that occur
    rows = pinned(rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n")))
    return rows.join(masks.occurring(rows, k, "mask"), "mask").groupBy("pattern_id").agg(F.sum("n").alias("cnt"))


def motif3_closed(g: Graph) -> DataFrame:
    """(pattern_id, cnt) of 3 vertices, from degrees and triangles."""
    d = g.degree().agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).alias("wedges"))
    t = kclique_count(g, 3)
    both = d.crossJoin(t)  # two tables of one row
    rows = F.array(F.struct(F.lit(22).alias("pattern_id"), (F.col("wedges") - 3 * F.col("found")).alias("cnt")), F.struct(F.lit(42).alias("pattern_id"), F.col("found").alias("cnt")))
    return both.select(F.explode(rows).alias("r")).select("r.pattern_id", F.col("r.cnt").cast("long").alias("cnt")).where("cnt > 0")


def motif4_closed(g: Graph) -> DataFrame:
    """(pattern_id, cnt) of 4 vertices without enumerating them: from degrees, triangles by edge, common neighbours and 4-cliques.

    The non-induced counts of stars, paths, tailed triangles, 4-cycles and diamonds are turned into induced ones by a linear inversion.
    A 4-cycle is counted at its last vertex in the order of (degree, id), from paths to the opposite one through vertices before it: as many
    as the sum of the lesser degrees over the edges, at most the edges' number to the power of 1.5, so a hub's leaves make none.
    """
    deg = g.degree()
    ds, dd = (deg.select(F.col("v").alias(end), F.col("degree").alias(name)) for end, name in (("src", "ds"), ("dst", "dd")))
    tri = triangles_per_edge(g)
    e = g.edges.select("src", "dst").join(ds, "src").join(dd, "dst").join(tri, ["src", "dst"], "left").withColumn("t", F.coalesce("triangles", F.lit(0)))
    star = deg.agg(F.sum(F.expr("degree * (degree - 1) * (degree - 2) div 6")).alias("star"))
    # a triangle's degrees are summed over its edges, which see each corner twice
    per_edge = e.agg(F.sum(F.expr("(ds - 1) * (dd - 1)")).alias("paths"), F.sum("t").alias("t3"), F.sum(F.expr("t * (ds + dd)")).alias("dsum2"), F.sum(F.expr("t * (t - 1) div 2")).alias("dia"))
    both = F.array(*(F.struct(F.col(a).alias("v"), F.col(x).alias("dv"), F.col(b).alias("u"), F.col(y).alias("du")) for a, x, b, y in (("src", "ds", "dst", "dd"), ("dst", "dd", "src", "ds"))))
    sym = e.select(F.explode(both).alias("x")).select("x.*")
    before = lambda d, v: (F.col(d) < F.col("du")) | ((F.col(d) == F.col("du")) & (F.col(v) < F.col("u")))
    middle = sym.where(before("dv", "v")).drop("dv")
    wedge = middle.join(sym.select("v", F.col("u").alias("w"), F.col("du").alias("dw")), "v").where(before("dw", "w")).groupBy("u", "w").agg(F.count(F.lit(1)).alias("c"))
    cycle = wedge.agg(F.sum(F.expr("c * (c - 1) div 2")).alias("c2"))
    one = star.crossJoin(per_edge).crossJoin(cycle).crossJoin(kclique_count(g, 4).withColumnRenamed("found", "n4"))  # tables of one row
    one = one.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("star", "paths", "t3", "dsum2", "dia", "c2", "n4")))
    one = one.selectExpr("star", "paths - t3 as path", "dsum2 div 2 - 2 * t3 as tail", "c2 as cyc", "dia", "n4")
    one = one.selectExpr("*", "dia - 6 * n4 as m175").selectExpr("*", "cyc - m175 - 3 * n4 as m170", "tail - 4 * m175 - 12 * n4 as m107")
    one = one.selectExpr("n4 as m255", "m175", "m170", "m107", "star - m107 - 2 * m175 - 4 * n4 as m87", "path - 2 * m107 - 4 * m170 - 6 * m175 - 12 * n4 as m90")
    rows = F.array(*(F.struct(F.lit(i).alias("pattern_id"), F.col(f"m{i}").alias("cnt")) for i in (87, 90, 107, 170, 175, 255)))
    return one.select(F.explode(rows).alias("r")).select("r.pattern_id", F.col("r.cnt").cast("long").alias("cnt")).where("cnt > 0")


def level_counts(g: Graph, k: int) -> DataFrame:
    """(level, cnt): connected induced subgraphs of each size from 1 (vertices with an edge) to k."""
    levels = [g.degree().agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(1).alias("level"), "cnt"), g.edges.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(2).alias("level"), "cnt")]
    levels += [expand.induced(g, i).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(i).alias("level"), "cnt") for i in range(3, k + 1)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def keyword_distances(g: Graph, hops: int = 2, label: Callable[[Column], Column] = keyword_label, keywords: int = KEYWORDS) -> DataFrame:
    """(v, w, d): the least number of hops, up to hops, from v to a vertex with keyword w."""
    sym = g.symmetric()
    dist = g.degree().select("v", label(F.col("v")).cast("int").alias("w")).where(F.col("w") < keywords).withColumn("d", F.lit(0))
    near = dist
    for h in range(1, hops + 1):
        near = near.join(sym, "v").select(F.col("u").alias("v"), "w").distinct().withColumn("d", F.lit(h))
        dist = dist.unionByName(near)
    return dist.groupBy("v", "w").agg(F.min("d").alias("d"))


def distance_lines(distances: DataFrame, keywords: int = KEYWORDS) -> DataFrame:
    """(line): for people, each vertex of keyword_distances with its distance to each keyword, - where that is too far."""
    wide = distances.groupBy("v").pivot("w", list(range(keywords))).agg(F.min("d"))
    return wide.select(F.concat_ws(" ", F.concat(F.col("v"), F.lit(":")), *(F.coalesce(F.col(f"`{w}`").cast("string"), F.lit("-")) for w in range(keywords))).alias("line"))


def keyword_sets(g: Graph, k: int, mode: str = "cover", label: Callable[[Column], Column] | None = None, keywords: int = KEYWORDS) -> DataFrame:
    """(vertices): connected sets of at most k vertices with each keyword once, other vertices being plain.

    The keyword of a vertex is its label in g's table, if g has one (those from keywords on are plain, as are vertices without), else label(id). cover: all of them. minimal: those without a plain vertex that can go; what is left would be in the cover, so that is an anti-join.
    Sets grow from the vertices with keyword 0, with k - keywords plain vertices at most; only neighbours within reach of a missing keyword are added.
    """
    if g.labels is not None and not label:
        found = keyword_sets(g.labelled(), k, mode, lambda v: F.when(label_of(v) < 0, keywords).otherwise(label_of(v)), keywords)
        return found.select(F.array_sort(F.transform("vertices", id_of)).alias("vertices"))
    w = label or keyword_label
    plain = lambda v: w(v) >= keywords
    sym = g.symmetric()
    start = g.degree().where(w(F.col("v")) == 0).select(F.array("v").alias("vertices"))

    def accept(vs: Column, c: Column) -> Column:
        fresh = ~F.exists(vs, lambda v: w(v) == w(c))
        return F.when(plain(c), F.size(F.filter(vs, plain)) < k - keywords).otherwise(fresh)

    held = lambda vs: F.size(F.filter(vs, lambda v: ~plain(v))) == keywords
    found, sets = None, start
    for size in range(2, k + 1):
        sets = expand.grow(sym, sets, accept)
        if size >= keywords:
            full = sets.where(held(F.col("vertices")))
            found = full if found is None else found.unionByName(full)
    if mode == "cover":
        return found
    found = pinned(found)
    less = found.select("vertices", F.explode(F.filter("vertices", plain)).alias("p")).select("vertices", F.array_remove("vertices", F.col("p")).alias("rest"))
    reducible = less.join(found.select(F.col("vertices").alias("rest")), "rest", "left_semi").select("vertices").distinct()
    return found.join(reducible, "vertices", "left_anti")


@dataclass
class PatternQuery:
    """A query of one's own, as builders of Columns that stay in the plan.

    pfilter(vertices, candidate): may the candidate be added? filter(vertices, mask): may the set be explored further (anti-monotone)?
    match(vertices, mask): is a set of k vertices reported? python_match, for what Columns can't say, gets pandas batches of the
    rows (v0.., mask) and returns booleans. symmetric: only complete subgraphs. init is called before, output with the result (of a stream: each
    epoch's changes). pupdate(added, removed, epoch) is called before an epoch of a stream is evaluated.
    """

    k: int
    pfilter: Callable | None = None
    filter: Callable | None = None
    match: Callable | None = None
    python_match: Callable[[pd.DataFrame], pd.Series] | None = None
    symmetric: bool = False
    init: Callable[[], None] | None = None
    output: Callable[[DataFrame], None] | None = None
    pupdate: Callable[[DataFrame, DataFrame, int], None] | None = None
    options: dict = field(default_factory=dict)

    def keep(self, vs: list[Column], mask: Column) -> Column:
        """symmetric and filter, of the first vertices of a set."""
        ok = masks.complete(mask, len(vs)) if self.symmetric else F.lit(True)
        return ok & self.filter(vs, mask) if self.filter else ok

    def holds(self, vs: list[Column], mask: Column) -> Column:
        """Does a static run report the set, which it reaches in this order? (But for python_match.)"""
        ok = mask.isNotNull()
        for i, v in enumerate(vs if self.pfilter else []):
            ok = ok & self.pfilter(vs[:i], v)
        for i in range(2, self.k + 1):
            ok = ok & self.keep(vs[:i], mask.bitwiseAND(F.lit((1 << masks.T_N[i]) - 1)))
        return ok & self.match(vs, mask) if self.match else ok

    def rows(self, g: Graph) -> DataFrame:
        """v0..v(k-1), mask of the matches."""
        rows = expand.induced(g, self.k, self.pfilter, self.keep if self.symmetric or self.filter else None)
        if self.match:
            rows = rows.where(self.match([F.col(f"v{i}") for i in range(self.k)], F.col("mask")))
        if self.python_match:
            test = self.python_match
            rows = rows.mapInPandas(lambda batches: (b[test(b).to_numpy(bool)] for b in batches), rows.schema)
        return rows

    def run(self, g: Graph) -> DataFrame:
        """rows(g), after init; output gets them too."""
        if self.init:
            self.init()
        rows = self.rows(g)
        if self.output:
            self.output(rows)
        return rows
