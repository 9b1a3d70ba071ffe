"""What an epoch changes: matches added, removed and modified between two snapshots, found from the changed edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import masks
from motifloom.graph import Graph
from motifloom.operators.mining import PatternQuery
from motifloom.plans import expand
from motifloom.plans.cut import BROADCAST_ROWS, pinned, small


def _flagged(before: Graph, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(src, dst, old, now) of the edges of both snapshots: 1 where the edge is there. added and removed are what they differ by."""
    flag = lambda df, old, now: df.select("src", "dst", F.lit(old).alias("old"), F.lit(now).alias("now"))
    kept, n = before.edges.select("src", "dst"), removed.count()
    if not n:
        return flag(kept, 1, 1).unionByName(flag(added, 0, 1))
    gone = removed.select("src", "dst")
    kept = kept.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, ["src", "dst"], "left_anti")
    return flag(kept, 1, 1).unionByName(flag(added, 0, 1)).unionByName(flag(removed, 1, 0))


def _inserted(mask: Column, at: Column, k: int) -> Column:
    """A mask of k vertices as one of k + 1, where a vertex without edges comes in before position at."""
    out = mask  # at the end nothing moves
    for place in range(k):
        moved = F.lit(0)
        for i in range(k):
            for j in range(i):
                b = F.shiftright(mask, masks.bit(i, j)).bitwiseAND(F.lit(1))
                moved = moved.bitwiseOR(F.shiftleft(b, masks.bit(i + (i >= place), j + (j >= place))))
        out = F.when(at == place, moved).otherwise(out)
    return out


def touched_sets(before: Graph, added: DataFrame, removed: DataFrame, k: int, accept: Callable[[Column, Column], Column] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """vertices, old, now: sets of k vertices, connected by edges of either snapshot, that hold both ends of a changed edge, with their masks in both. Seeded by the
    changed edges (or those in seeds: src, dst, new). A level joins the vertices with their edges, a candidate's bits are put together where equal sets meet, and the
    graph is shuffled only where the sets are counted to be many. accept(vertices, new) prunes what is grown from a seed."""
    edges = _flagged(before, added, removed)
    both = F.array(*(F.struct(F.col(a).alias("v"), F.col(b).alias("u")) for a, b in (("src", "dst"), ("dst", "src"))))
    sym = edges.select("old", "now", F.explode(both).alias("e")).select("e.v", "e.u", F.col("old").alias("o"), F.col("now").alias("n"))
    if seeds is None:
        seeds = added.select("src", "dst", F.lit(True).alias("new")).unionByName(removed.select("src", "dst", F.lit(False).alias("new")))
    sets = seeds.distinct().select(F.array("src", "dst").alias("vertices"), F.when(F.col("new"), 0).otherwise(1).alias("old"), F.when(F.col("new"), 1).otherwise(0).alias("now"))
    for size in range(2, k):
        sets = sets if size == 2 else pinned(sets)
        if size * sets.count() <= BROADCAST_ROWS:
            rows = sym.join(F.broadcast(sets.select("*", F.explode("vertices").alias("v"))), "v")
        else:
            rows = sets.select("*", F.explode("vertices").alias("v")).join(expand.near(sym, sets), "v")
        rows = rows.where(~F.array_contains("vertices", F.col("u")))
        if accept:
            rows = rows.where(accept(F.col("vertices"), F.col("u")))
        place = lambda x: F.size(F.filter("vertices", lambda y: y < x))
        rows = rows.withColumns({"at": place(F.col("u")), "of": place(F.col("v"))}).withColumn("of", F.col("of") + (F.col("of") >= F.col("at")).cast("int"))
        high, low = F.greatest("at", "of"), F.least("at", "of")
        bit = F.call_function("shiftleft", F.lit(1), (high * (high - 1) / 2).cast("int") + low)
        mask = lambda name, there: _inserted(F.col(name), F.col("at"), size).bitwiseOR(F.when(F.col(there) == 1, bit).otherwise(0))  # noqa: B023, E731
        rows = rows.select(F.array_sort(F.array_append("vertices", F.col("u"))).alias("vertices"), mask("old", "o").alias("old"), mask("now", "n").alias("now"))
        sets = rows.groupBy("vertices").agg(F.bit_or("old").alias("old"), F.bit_or("now").alias("now"))
    return sets


def set_changes(before: Graph, added: DataFrame, removed: DataFrame, k: int, accept: Callable[[Column, Column], Column] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """vertices, old, now (masks in the snapshots before and after) of every touched set; a changed edge is in each, so no mask is as it was."""
    return touched_sets(before, added, removed, k, accept, seeds)


def cliques_of(g: Graph, seeds: DataFrame, k: int) -> DataFrame:
    """(vertices, seeds): the k-cliques of g that hold a seed edge, and the mask of their edges that are seeds.

    A seed's common neighbours come from the edges of its end of lower degree and are looked up among those of the other; further vertices are joined
    in ascending order. So nothing is listed in one row, and only edges of the seeds' ends are shuffled for triangles.
    """
    seeds = seeds.select("src", "dst")
    n = seeds.count()
    if not n:
        return seeds.sparkSession.createDataFrame([], "vertices array<bigint>, seeds int")
    rows, new = seeds, []
    if k > 2:
        few = (lambda df: F.broadcast(df)) if 2 * n <= BROADCAST_ROWS else (lambda df: df)
        own = g.symmetric().join(few(seeds.select(F.explode(F.array("src", "dst")).alias("v"))), "v", "left_semi")
        d = own.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
        of = lambda end: few(d.select(F.col("v").alias(end), F.col("d").alias(f"d{end}")))
        low = F.col("dsrc") <= F.col("ddst")
        ends = seeds.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", F.when(low, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("other"))
        wedges = own.join(few(ends), "v").where("u != other")
        common = wedges.join(own.select(F.col("v").alias("other"), "u"), ["other", "u"], "left_semi").select("src", "dst", F.col("u").alias("x2"))
        rows = common = pinned(common) if k > 3 else common
        new = ["x2"]
    for i in range(3, k):
        last, c = new[-1], f"x{i}"
        rows = rows.join(g.edges.select(F.col("src").alias(last), F.col("dst").alias(c)), last).join(common.withColumnRenamed("x2", c), ["src", "dst", c], "left_semi")
        for x in new[:-1]:
            rows = rows.join(g.edges.select(F.col("src").alias(x), F.col("dst").alias(c)), [x, c], "left_semi")
        new.append(c)
    rows = rows.select("src", "dst", F.array_sort(F.array("src", "dst", *new)).alias("vertices"))
    place = lambda end: F.array_position("vertices", F.col(end)).cast("int") - 1
    bit = F.expr("shiftleft(1, cast(j * (j - 1) / 2 as int) + i)")
    return rows.withColumns({"i": place("src"), "j": place("dst")}).groupBy("vertices").agg(F.bit_or(bit).alias("seeds"))


def clique_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, k: int) -> DataFrame:
    """vertices, status (add or del), edges, new_edges: the k-cliques that came and those that went; a clique is never modified. new_edges are those of a new clique that weren't there before."""
    whole = (1 << masks.T_N[k]) - 1
    mark = lambda rows, status, fresh: rows.select("vertices", F.lit(status).alias("status"), F.lit(whole).alias("edges"), fresh.cast("int").alias("new_edges"))
    return mark(cliques_of(after, added, k), "add", F.col("seeds")).unionByName(mark(cliques_of(before, removed, k), "del", F.lit(0)))


def motif_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, k: int) -> DataFrame:
    """vertices, status (add, del or mod), old_id, new_id: sets that became, ceased to be or changed as connected subgraphs."""
    rows = set_changes(before, added, removed, k)
    rows = rows if k <= masks.LISTED else pinned(rows)
    table = masks.occurring(rows, k, "old", "now").where("connected")
    old = table.select(F.col("mask").alias("old"), F.col("pattern_id").alias("old_id"))
    now = table.select(F.col("mask").alias("now"), F.col("pattern_id").alias("new_id"))
    rows = rows.join(old, "old", "left").join(now, "now", "left").where("old_id is not null or new_id is not null")
    status = F.when(F.col("old_id").isNull(), "add").when(F.col("new_id").isNull(), "del").otherwise("mod")
    return rows.select("vertices", status.alias("status"), "old_id", "new_id")


def pattern_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, query: PatternQuery, accept: Callable[[Column, Column], Column] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """vertices, status (add, del or mod), edges, new_edges: sets of k vertices that query reports now, reported before, or reports both times with other edges.

    query's filters, symmetric, match and python_match are asked of both snapshots, on the vertices in the order in which its static run reaches them. edges is the mask
    now (for del: before) of the vertices in ascending order, new_edges what it has that wasn't there before. accept(vertices, new) and seeds prune the search.
    """
    k = query.k
    if query.symmetric:
        sets = pinned(clique_changes(after, before, added, removed, k).select("vertices").distinct())
        rows = expand.with_masks(sets, k, old=before.edges, now=after.edges)
    else:
        rows = set_changes(before, added, removed, k, accept, seeds)
    rows = rows if k <= masks.LISTED else pinned(rows)
    order = masks.orders(rows, k, "old", "now")
    for name in ("old", "now"):
        rows = rows.join(order.select(F.col("mask").alias(name), F.col("order").alias(f"{name}_order"), F.col("in_order").alias(f"{name}_mask")), name, "left")
        vs = [F.col("vertices")[F.col(f"{name}_order")[i]] for i in range(k)]
        rows = rows.withColumn(f"{name}_is", F.coalesce(query.holds(vs, F.col(f"{name}_mask")), F.lit(False)))
    rows = rows.where("old_is or now_is")
    if query.python_match:
        test = query.python_match

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name in ("old", "now"):
                    some = b[b[f"{name}_is"]]
                    if len(some):
                        at = [np.asarray(v)[np.asarray(o)] for v, o in zip(some["vertices"], some[f"{name}_order"], strict=True)]
                        asked = pd.DataFrame(np.array(at, np.int64).reshape(-1, k), columns=[f"v{i}" for i in range(k)], index=some.index).assign(mask=some[f"{name}_mask"].astype("int32"))
                        b.loc[some.index, f"{name}_is"] = test(asked).to_numpy(bool)
                yield b

        rows = rows.mapInPandas(ask, rows.schema).where("old_is or now_is")
    status = F.when(~F.col("old_is"), "add").when(~F.col("now_is"), "del").otherwise("mod")
    fresh = F.when(F.col("now_is"), F.col("now").bitwiseAND(F.bitwise_not("old"))).otherwise(0)
    return rows.select("vertices", status.alias("status"), F.when(F.col("now_is"), F.col("now")).otherwise(F.col("old")).alias("edges"), fresh.alias("new_edges"))


def labelled_clique_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, k: int, old_labels: DataFrame, new_labels: DataFrame) -> DataFrame:
    """clique_changes of the k-cliques whose labels (id, label) all differ, by old_labels before and new_labels after.

    Such a clique is one of the edges whose ends' labels are known and differ, so the changes are those of the graphs of such edges: a new label can
    add and remove edges of them. new_edges counts edges that weren't there at all."""
    labels = old_labels.select(F.col("id").alias("_id"), F.col("label").alias("a")).join(new_labels.select(F.col("id").alias("_id"), F.col("label").alias("b")), "_id", "full")
    rows = _flagged(before, added, removed)
    for end in ("src", "dst"):
        rows = rows.join(labels.withColumnsRenamed({"a": f"a_{end}", "b": f"b_{end}"}), F.col(end) == F.col("_id")).drop("_id")
    differ = lambda there, x: F.coalesce((F.col(there) == 1) & (F.col(f"{x}_src") != F.col(f"{x}_dst")), F.lit(False))
    rows = pinned(rows.select("src", "dst", differ("old", "a").alias("was"), differ("now", "b").alias("is")).where("was or is"))
    edges = lambda which: rows.where(which).select("src", "dst")
    found = clique_changes(Graph(edges("is")), Graph(edges("was")), edges("is and not was"), edges("was and not is"), k)
    if not added.count():
        return found.withColumn("new_edges", F.lit(0))
    found = pinned(found.select("vertices", "status", "edges"))
    fresh = expand.with_masks(found.select("vertices"), k, new=added)
    return found.join(fresh, "vertices").select("vertices", "status", "edges", F.when(F.col("status") == "add", F.col("new")).otherwise(0).alias("new_edges"))


def cached_clique4_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangle changes and the 4-clique changes, the latter with cached (bool), from triangles (vertices): those of before, kept from the epochs before.

    A 4-clique that has a changed edge has two triangles on it, found as the triangle changes are; a third closes it. cached: whether that one was there
    before (a hit of the kept table) or has a new edge itself.
    """
    t = pinned(clique_changes(after, before, added, removed, 3))
    abc = [F.col("vertices")[i].alias(x) for i, x in enumerate("abc")]
    kept = triangles.select(*abc)
    gone = t.where("status = 'del'").select(*abc)
    come = t.where("status = 'add'").select(*abc)
    whole, out = (1 << masks.T_N[4]) - 1, None
    for status, seeds, fresh, all_of in (("add", added, come, kept.join(gone, list("abc"), "left_anti").withColumn("cached", F.lit(True)).unionByName(come.withColumn("cached", F.lit(False)))), ("del", removed, gone, kept.withColumn("cached", F.lit(True)))):
        s = seeds.select("src", "dst").distinct()
        third = F.when(F.col("a") < F.col("src"), F.col("a")).when(F.col("c") > F.col("dst"), F.col("c")).otherwise(F.col("b"))
        on = None
        for x, y in ("ab", "ac", "bc"):
            one = fresh.join(s, (F.col(x) == F.col("src")) & (F.col(y) == F.col("dst"))).select("src", "dst", third.alias("x"))
            on = one if on is None else on.unionByName(one)
        pairs = on.join(on.withColumnRenamed("x", "y"), ["src", "dst"]).where("x < y")
        corner = lambda end: F.array_sort(F.array(F.col(end), F.col("x"), F.col("y")))
        for end in ("src", "dst"):
            pairs = pairs.withColumn("t", corner(end))
            held = all_of.select(*(F.col(v).alias(f"_{v}") for v in "abc"), F.col("cached").alias(f"{end}_cached"))
            pairs = pairs.join(held, (F.col("t")[0] == F.col("_a")) & (F.col("t")[1] == F.col("_b")) & (F.col("t")[2] == F.col("_c"))).drop("_a", "_b", "_c", "t")
        vertices = F.array_sort(F.array("src", "dst", "x", "y"))
        place = lambda end: F.array_position("vertices", F.col(end)).cast("int") - 1
        rows = pairs.select("src", "dst", vertices.alias("vertices"), (F.col("src_cached") & F.col("dst_cached")).alias("cached")).withColumns({"i": place("src"), "j": place("dst")})
        bit = F.expr("shiftleft(1, cast(j * (j - 1) / 2 as int) + i)")
        rows = rows.groupBy("vertices").agg(F.bit_or(bit).alias("seeds"), F.bool_and("cached").alias("cached"))
        rows = rows.select("vertices", F.lit(status).alias("status"), F.lit(whole).alias("edges"), F.when(F.lit(status) == "add", F.col("seeds")).otherwise(0).alias("new_edges"), "cached")
        out = rows if out is None else out.unionByName(rows)
    return t, out


def distances_near(g: Graph, vertices: DataFrame, hops: int, label: Callable[[Column], Column], keywords: int) -> DataFrame:
    """(v, w, d) of vertices (v): the least number of hops, up to hops, to a vertex of g with keyword w. Only the edges around them are taken, and keywords
    travel along these: a hop has at most a row for each vertex and keyword, however many vertices are near one another."""
    asked = around = pinned(vertices.select("v").distinct())
    for _ in range(hops - 1):
        around = pinned(around.unionByName(expand.near(g.symmetric(), around.select(F.array("v").alias("vertices"))).select(F.col("u").alias("v"))).distinct())
    own = asked.select("v", label(F.col("v")).cast("int").alias("w")).where(F.col("w") < keywords)
    every = own.withColumn("d", F.lit(0))
    if hops:
        sym = pinned(expand.near(g.symmetric(), around.select(F.array("v").alias("vertices"))).select("v", "u"))
        reached = sym.select("v", label(F.col("u")).cast("int").alias("w")).where(F.col("w") < keywords).distinct()
        for h in range(1, hops + 1):
            if h > 1:
                reached = sym.join(reached.select(F.col("v").alias("u"), "w"), "u").select("v", "w").distinct()
            every = every.unionByName(reached.withColumn("d", F.lit(h)))
    return every.join(asked, "v", "left_semi").groupBy("v", "w").agg(F.min("d").alias("d"))


def distance_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, hops: int, label: Callable[[Column], Column], keywords: int) -> DataFrame:
    """(v, w, d) now of the vertices whose distances the epoch can change, those within hops - 1 of a changed edge; a vertex without any keyword near has a row with nulls."""
    ends = added.select("src", "dst").unionByName(removed.select("src", "dst")).select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    both = Graph(before.edges.select("src", "dst").unionByName(added.select("src", "dst"))).symmetric()
    around = pinned(ends)
    for _ in range(hops - 1):
        around = pinned(around.unionByName(expand.near(both, around.select(F.array("v").alias("vertices"))).select(F.col("u").alias("v"))).distinct())
    now = distances_near(after, around, hops, label, keywords)
    alive = around.join(expand.near(after.symmetric(), around.select(F.array("v").alias("vertices"))).select("v"), "v", "left_semi")
    return around.join(now.join(alive, "v", "left_semi"), "v", "left").select("v", "w", "d")


def keyword_changes(after: Graph, before: Graph, added: DataFrame, removed: DataFrame, k: int, label: Callable[[Column], Column], keywords: int) -> DataFrame:
    """pattern_changes of the sets of at most k vertices that hold each keyword once, other vertices being plain.

    A changed edge is a seed only if both ends together are near enough to every keyword: no set of k vertices reaches farther than k - 2 hops from it."""
    plain = lambda v: label(v) >= keywords

    def accept(vs: Column, c: Column) -> Column:
        return F.when(plain(c), F.size(F.filter(vs, plain)) < k - keywords).otherwise(~F.exists(vs, lambda v: label(v) == label(c)))

    def match(vs: list[Column], mask: Column) -> Column:
        held = F.filter(F.array(*vs), lambda v: ~plain(v))
        return (F.size(held) == keywords) & (F.size(F.array_distinct(F.transform(held, label))) == keywords)

    changed = added.select("src", "dst", F.lit(True).alias("new")).unionByName(removed.select("src", "dst", F.lit(False).alias("new")))
    # a seed with more plain vertices than a set may have, or with one keyword twice, is in no set
    ends = [F.col("src"), F.col("dst")]
    n_plain = sum((plain(v).cast("int") for v in ends[1:]), plain(ends[0]).cast("int"))
    changed = pinned(changed.where((n_plain <= k - keywords) & ((n_plain > 0) | (label(ends[0]) != label(ends[1])))))
    both = Graph(before.edges.select("src", "dst").unionByName(added.select("src", "dst")))
    ends = changed.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    near = distances_near(both, ends, k - 2, label, keywords)
    close = changed.select("src", "dst", F.explode(F.array("src", "dst")).alias("v")).join(near, "v").groupBy("src", "dst").agg(F.count_distinct("w").alias("n")).where(F.col("n") == keywords)
    changed = pinned(changed.join(close, ["src", "dst"], "left_semi").select("src", "dst", "new"))

    out = None
    for size in range(max(2, keywords), k + 1):
        one = pattern_changes(after, before, added, removed, PatternQuery(size, match=match), accept, changed.where(n_plain <= size - keywords))
        out = one if out is None else out.unionByName(one)
    return out


def motif_delta(changes: DataFrame) -> DataFrame:
    """(pattern_id, delta) of motif_changes: one less for each old pattern, one more for each new one."""
    both = F.array(F.struct(F.col("old_id").alias("id"), F.lit(-1).alias("n")), F.struct(F.col("new_id").alias("id"), F.lit(1).alias("n")))
    rows = changes.select(F.explode(both).alias("x")).where("x.id is not null")
    return rows.groupBy(F.col("x.id").alias("pattern_id")).agg(F.sum("x.n").alias("delta")).where("delta != 0")


def with_totals(per_epoch: DataFrame, value: str = "delta", by: list[str] | None = None) -> DataFrame:
    """per_epoch (ts, value, by) with total, the running sum over ts. One row an epoch and group: epochs are few."""
    from pyspark.sql import Window

    keys = by or []
    order = Window.partitionBy(*keys).orderBy("ts") if keys else Window.partitionBy(F.lit(0)).orderBy("ts")
    return per_epoch.withColumn("total", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
