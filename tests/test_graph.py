"""Golden tiny graphs, properties against brute force, and the functions on masks."""

from itertools import combinations, permutations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifloom.functions import masks
from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.plans import expand
from motifloom.plans.cut import pinned

PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
# name: edges, triangles, 4-cliques, colour triangles, motifs of 3 and of 4 vertices
GOLDEN = {
    "triangle": ([(0, 1), (0, 2), (1, 2)], 1, 0, 1, {42: 1}, {}),
    "k4": (list(combinations(range(4), 2)), 4, 1, 2, {42: 4}, {255: 1}),
    "k5": (list(combinations(range(5), 2)), 10, 5, 4, {42: 10}, {255: 5}),
    "k6": (list(combinations(range(6), 2)), 20, 15, 8, {42: 20}, {255: 15}),
    "star": ([(0, 1), (0, 2), (0, 3), (0, 4)], 0, 0, 0, {22: 6}, {87: 4}),
    "path": ([(0, 1), (1, 2), (2, 3), (3, 4)], 0, 0, 0, {22: 3}, {90: 2}),
    "cycle": ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], 0, 0, 0, {22: 5}, {90: 5}),
    "diamond": ([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 2, 0, 2, {22: 2, 42: 2}, {175: 1}),
    "bull": ([(0, 1), (0, 2), (1, 2), (1, 3), (2, 4)], 1, 0, 1, {22: 4, 42: 1}, {90: 1, 107: 2}),
    "bowtie": ([(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)], 2, 0, 2, {22: 4, 42: 2}, {107: 4}),
    "petersen": (PETERSEN, 0, 0, 0, {22: 30}, {87: 10, 90: 60}),
}


def graph(spark, edges):
    return Graph.from_pairs(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long"))


def census(df):
    return {r["pattern_id"]: r["cnt"] for r in df.collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    edges, k3, k4, colour, m3, m4 = GOLDEN[name]
    g = graph(spark, edges)
    assert mining.kclique_count(g, 3).first()["found"] == k3
    assert mining.kclique_count(g, 4).first()["found"] == k4
    assert mining.color_clique_count(g, 3).first()["found"] == colour
    assert census(mining.motif_census(g, 3)) == m3 == census(mining.motif3_closed(g))
    assert census(mining.motif_census(g, 4)) == m4 == census(mining.motif4_closed(g))


def test_mask_constants():
    assert masks.T_N == [0, 0, 1, 3, 6, 10, 15, 21, 28]
    assert [masks.row_mask(i) for i in range(8)] == [2131019, 4262037, 8524070, 17048120, 34096064, 68189184, 136282112, 266338304]


def test_mask_columns(spark):
    full = (1 << masks.T_N[4]) - 1
    row = spark.range(1).select(
        masks.degree(F.lit(full), 0, 4).alias("d"), masks.old_degree(F.lit(full), F.lit(1), 0, 4).alias("o"), masks.n_edges(F.lit(full)).alias("n"), masks.complete(F.lit(full), 4).alias("c"),
        masks.degree_id(F.lit(full), 4).alias("i"), masks.has(F.lit(4), 2, 1).alias("h"), masks.connect(F.lit(0), 2, 1).alias("k"), masks.truncate(F.array(F.lit(5), F.lit(6), F.lit(7)), F.lit(7), 2)[1].alias("t"),
        masks.describe(F.array(F.lit(5), F.lit(6)), F.lit(1), F.lit(1), 2).alias("text"),
    ).first()
    assert (row["d"], row["o"], row["n"], row["c"], row["i"], row["h"], row["k"], row["t"]) == (3, 2, 6, True, 255, True, 4, 1)
    assert row["text"] == "[5 6] 5-6 new"


def test_input_cleaning(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 2), (None, 3), (9, 7)], "src long, dst long")
    assert sorted(map(tuple, Graph.from_pairs(rows).edges.collect())) == [(1, 2), (7, 9)]
    empty = graph(spark, [])
    assert mining.kclique_count(empty, 3).first()["found"] == 0
    assert mining.motif4_closed(empty).count() == mining.motif3_closed(empty).count() == mining.motif_census(empty, 3).count() == 0


def brute_sets(edges, k):
    e = {frozenset(x) for x in edges}
    for s in combinations(sorted({v for x in edges for v in x}), k):
        inside = [p for p in combinations(s, 2) if frozenset(p) in e]
        seen, todo = {s[0]}, [s[0]]
        while todo:
            v = todo.pop()
            for p in inside:
                if v in p:
                    w = p[0] if p[1] == v else p[1]
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
        if len(seen) == k:
            yield s, inside


def brute_census(edges, k):
    out = {}
    for s, inside in brute_sets(edges, k):
        name = 0
        for d in sorted(sum(v in p for p in inside) for v in s):
            name = name * 4 + d
        out[name] = out.get(name, 0) + 1
    return out


EDGES = st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)).filter(lambda x: x[0] < x[1]), max_size=24)
FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(EDGES)
def test_against_brute_force(spark, edges):
    g = graph(spark, edges)
    for k in (3, 4, 5):
        found = {tuple(r["vertices"]) for r in expand.cliques(g, k).collect()}
        assert found == {s for s, inside in brute_sets(edges, k) if len(inside) == k * (k - 1) // 2}
        assert mining.kclique_count(g, k).first()["found"] == len(found)
    for k in (3, 4):
        assert census(mining.motif_census(g, k)) == brute_census(edges, k)


def test_ids_do_not_matter(spark):
    edges = GOLDEN["bull"][0] + [(3, 4), (0, 3)]
    moved = [(a * 7919 % 101, b * 7919 % 101) for a, b in edges]
    assert census(mining.motif_census(graph(spark, edges), 4)) == census(mining.motif_census(graph(spark, moved), 4))


def test_motif5_counts_every_set(spark):
    edges = PETERSEN
    got = census(mining.motif_census(graph(spark, edges), 5))
    assert sum(got.values()) == sum(1 for _ in brute_sets(edges, 5))
    assert len(got) > 1


@pytest.mark.parametrize("k", [4, 5, 6, 7])
def test_census_of_larger_sets(spark, k):
    """Patterns are told apart as isomorphism does: their number and counts against canonical forms by all permutations."""
    edges = [(i, (i + 1) % 8) for i in range(8)] + [(0, 3), (1, 5), (2, 6)]
    want = {}
    for s, inside in brute_sets([tuple(sorted(e)) for e in edges], k):
        at = {v: i for i, v in enumerate(s)}
        form = min(sum(1 << masks.bit(p[at[a]], p[at[b]]) for a, b in inside) for p in permutations(range(k)))
        want[form] = want.get(form, 0) + 1
    got = census(mining.motif_census(graph(spark, edges), k))
    assert got == want if k > 4 else sorted(got.values()) == sorted(want.values())


def test_too_many_vertices(spark):
    with pytest.raises(ValueError, match="from 2 to 8"):
        mining.motif_census(graph(spark, [(0, 1)]), 9)
    with pytest.raises(ValueError, match="too many"):
        masks.patterns(6)


def test_canonical_orders_are_the_enumerations(spark):
    edges = PETERSEN + [(0, 7), (1, 8)]
    for k in (3, 4, 5):
        for r in expand.induced(graph(spark, edges), k).collect():
            vs = sorted(r[:k])
            mask = sum(1 << masks.bit(i, j) for i in range(k) for j in range(i) if (vs[j], vs[i]) in edges or (vs[i], vs[j]) in edges)
            order, in_order = masks.canonical_order(mask, k)
            assert [vs[i] for i in order] == list(r[:k]) and in_order == r["mask"]


def test_induced_without_lists(spark):
    g = graph(spark, PETERSEN + [(0, 7), (1, 8), (2, 9)])
    odd = lambda vs, c: (c % 4 != 3) if vs else F.lit(True)
    few = lambda vs, mask: masks.n_edges(mask) <= len(vs)
    for k in (2, 3, 4, 5):
        for args in ((), (odd,), (None, few), (odd, few)):
            assert sorted(map(tuple, expand.induced(g, k, *args, lists=True).collect())) == sorted(map(tuple, expand.induced(g, k, *args, lists=False).collect()))


def test_star_of_many_leaves(spark):
    """A hub makes neither wedges nor long rows: motifs in closed form, cliques, an epoch at the hub, a search with a filter."""
    from motifloom.streaming import changes

    n = 100_000
    leaves = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    g = Graph(leaves.unionByName(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")))
    got = census(mining.motif4_closed(g))
    # stars of three leaves, triangles with a tail: each of the two triangles and another leaf
    assert got == {87: n * (n - 1) * (n - 2) // 6 - 2 * (n - 2), 107: 2 * (n - 2)}
    assert mining.kclique_count(g, 3).first()["found"] == 2
    added = spark.createDataFrame([(1, 3), (5, 6)], "src long, dst long")
    after = Graph(g.edges.unionByName(added))
    assert changes.clique_changes(after, g, added, added.limit(0), 3).count() == 2
    near = mining.PatternQuery(3, pfilter=lambda vs, c: c <= 5)
    assert near.rows(g).count() == 10


def test_labels_from_a_table(spark):
    edges = list(combinations(range(6), 2))
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 0), (4, 9)], "id long, label long")
    g = Graph(graph(spark, edges).edges, labels)
    assert mining.color_clique_count(g, 3).first()["found"] == sum(len({x, y, z}) == 3 for x, y, z in combinations([1, 1, 2, 0, 9], 3))
    assert {tuple(r["vertices"]) for r in mining.keyword_sets(g, 3).collect()} == {(0, 2, 3), (1, 2, 3)}
    assert {tuple(r["vertices"]) for r in mining.keyword_sets(g, 4).collect()} == {(a, 2, 3, *p) for a in (0, 1) for p in ((), (4,), (5,))}
    assert [r["line"] for r in mining.distance_lines(mining.keyword_distances(graph(spark, [(0, 4), (4, 5)]), 1)).orderBy("line").collect()] == ["0: 0 - -", "4: 1 - -"]


def test_written_binary_graph(spark, tmp_path):
    from motifloom.sources import files

    g = graph(spark, [(0, 1), (1, 2), (0, 2), (5, 70_000)])
    files.write_binary(g, str(tmp_path))
    files.write_binary(g, str(tmp_path))  # a second run replaces the first
    e, off = files.binary_edges(spark, str(tmp_path / "edges"), split=8), files.binary_offsets(spark, str(tmp_path / "offsets"))
    assert [tuple(r) for r in e.orderBy("pos").collect()] == [(i, *p) for i, p in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (5, 70_000), (70_000, 5)])]
    assert off.count() == 70_001 and off.where("v = 70000").first()["off"] == 7 and files.misplaced(e, off).count() == 0
    files.write_binary(graph(spark, []), str(tmp_path / "none"))
    assert files.binary_edges(spark, str(tmp_path / "none" / "edges")).count() == 0


def test_keyword_search(spark):
    g = graph(spark, [(0, 3), (1, 3), (2, 3), (3, 4), (0, 1), (4, 32), (1, 2)])
    sets = lambda k, mode: {tuple(r["vertices"]) for r in mining.keyword_sets(g, k, mode).collect()}
    assert sets(3, "cover") == sets(3, "minimal") == {(0, 1, 2)}
    assert sets(4, "cover") == {(0, 1, 2), (0, 1, 2, 3)} and sets(4, "minimal") == {(0, 1, 2)}
    assert sets(5, "cover") == {(0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4), (1, 2, 3, 4, 32)}
    assert sets(5, "minimal") == {(0, 1, 2), (1, 2, 3, 4, 32)}


def test_views(spark):
    g = graph(spark, GOLDEN["bull"][0])
    assert {r["v"]: r["degree"] for r in g.degree().collect()} == {0: 2, 1: 3, 2: 3, 3: 1, 4: 1}
    assert {r["v"]: r["nb"] for r in g.adjacency().collect()}[1] == [0, 2, 3]
    assert g.symmetric().count() == 10 and g.forward().where("v = 0").count() == 2 and g.backward().where("v = 2").count() == 2
    assert g.core(2).edges.count() == 3 and g.seeds(3).count() == 1
    probes = spark.createDataFrame([(3, 1), (0, 4)], "a long, b long")
    assert [tuple(r) for r in g.has_edges(probes).collect()] == [(3, 1)]
    assert max(len(r["out"]) for r in g.oriented().collect()) <= 2


def test_custom_pattern_with_python(spark):
    calls = []
    q = mining.PatternQuery(3, python_match=lambda b: b["v0"] + b["v1"] + b["v2"] == 3, init=lambda: calls.append("init"), output=lambda df: calls.append(df.count()))
    rows = q.run(graph(spark, GOLDEN["k4"][0])).collect()
    assert [sorted((r["v0"], r["v1"], r["v2"])) for r in rows] == [[0, 1, 2]] and calls == ["init", 1]
    symmetric = mining.PatternQuery(3, symmetric=True).run(graph(spark, GOLDEN["bull"][0]))
    assert symmetric.count() == 1


def test_binary_and_text_sources(spark, tmp_path):
    from motifloom.sources import files

    edges = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    np.array(edges, "<u4").tofile(tmp_path / "g")
    np.array([0, 2, 4], "<u8").tofile(tmp_path / "off")
    got = files.binary_edges(spark, str(tmp_path / "g"), split=16)
    assert [(r["pos"], r["src"], r["dst"]) for r in got.orderBy("pos").collect()] == [(i, *e) for i, e in enumerate(edges)]
    assert got.rdd.getNumPartitions() == 3
    assert files.misplaced(got, files.binary_offsets(spark, str(tmp_path / "off"))).count() == 0
    np.array([0, 3, 4], "<u8").tofile(tmp_path / "bad")
    assert files.misplaced(got, files.binary_offsets(spark, str(tmp_path / "bad"))).count() == 1
    assert files.binary_graph(spark, f"file://{tmp_path}/g").edges.count() == 3
    (tmp_path / "t.txt").write_text("0 1\n 1\t2 \n# no\n2 0\n")
    assert files.text_graph(spark, str(tmp_path / "t.txt")).edges.count() == 3
    (tmp_path / "m.ini").write_text("x=1\nvertices=12\n")
    assert files.metadata_vertices(spark, str(tmp_path / "m.ini")) == 12


def test_sets_are_counted_in_slices(spark):
    """slices count what the whole enumeration has, and leave no shuffle files behind."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    rng = np.random.default_rng(4)
    pairs = sorted({tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(60)} | {(0, v) for v in range(1, 25)})
    g = Graph(spark.createDataFrame(pairs, "src long, dst long"))
    want = {r["mask"]: r["n"] for r in expand.induced(g, 4, lists=True).groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = {r["mask"]: r["n"] for r in expand.induced(g, 4, lists=False).groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert whole == want
    walks = sum(d**3 for d in (sum(v in p for p in pairs) for v in range(25)))
    before = shuffles()
    rows = expand.induced_counts(g, 4, walks // 3)
    assert shuffles() - before <= 8  # the degrees, not the levels of three slices or more
    assert {r["mask"]: r["n"] for r in rows.collect()} == want


def test_counted_sets_stay_where_they_lie(spark):
    """candidates are looked at without a shuffle, and neighbours in several parts give the counts of whole lists."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    rng = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(60)} | {(0, v) for v in range(1, 25)})
    g = Graph(pinned(spark.createDataFrame(pairs, "src long, dst long")))
    counts = lambda rows: {r["mask"]: r["n"] for r in rows.collect()}
    want = {k: counts(expand.induced(g, k, lists=True).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))) for k in (2, 3, 4, 5)}
    before = shuffled()
    assert counts(expand.induced_counts(g, 4)) == want[4]
    # what is written is the sets of three and less, not a row for each candidate of four
    assert sum(n for s, n in shuffled().items() if s not in before) < sum(want[4].values()) / 2
    for k in (2, 3, 4, 5):
        assert counts(expand.induced_counts(g, k, hub=6)) == want[k]
    assert expand.induced_counts(Graph(g.edges.limit(0)), 4).count() == 0
