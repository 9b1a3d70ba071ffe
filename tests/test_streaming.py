"""Epochs: the trace of a small stream, differences of snapshots, and a restart."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.streaming import changes
from motifloom.streaming.runner import UPDATE, GraphStream, replay_batches


def updates(spark, rows):
    return spark.createDataFrame([(t, a, b, 0, None, None) for t, a, b in rows], UPDATE)


TRACE = [
    [("EdgeAdd", 0, 2), ("EdgeAdd", 2, 3)], [("EdgeAdd", 1, 3), ("EdgeAdd", 3, 0)], [("EdgeAdd", 3, 4)], [("EdgeDel", 2, 0)], [("EdgeDel", 2, 3), ("EdgeDel", 7, 8)],
]


def test_trace_of_triangles(spark, tmp_path):
    s = GraphStream(spark, str(tmp_path / "g"), compact_every=2)
    s.preload(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    for epoch, rows in enumerate(TRACE):
        s.apply(updates(spark, rows), epoch)
        if epoch in (1, 3):
            s.apply(updates(spark, rows), epoch)  # an epoch that runs again changes nothing
    got = {r["ts"]: (r["added"], r["removed"], r["total"]) for r in s.totals().collect()}
    assert got == {-1: (0, 0, 0), 0: (1, 0, 1), 1: (3, 0, 4), 2: (0, 0, 4), 3: (0, 2, 2), 4: (0, 1, 1)}
    assert s.snapshot(1).edges.count() == 6 and s.snapshot(4).edges.count() == 5


def test_trace_of_motifs(spark, tmp_path):
    s = GraphStream(spark, str(tmp_path / "g"), kind="motif")
    s.preload(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    want = [{22: 1, 42: 1}, {22: -2, 42: 3}, {22: 3}, {22: 2, 42: -2}, {22: -1, 42: -1}]
    for epoch, rows in enumerate(TRACE):
        s.apply(updates(spark, rows), epoch)
    got = {}
    for r in s.totals().where("ts >= 0").collect():
        got.setdefault(r["ts"], {})[r["pattern_id"]] = r["delta"]
    assert [got[i] for i in range(5)] == want


def test_netting_labels_and_vertices(spark, tmp_path):
    s = GraphStream(spark, str(tmp_path / "g"))
    s.preload(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long"))
    rows = [("EdgeAdd", 5, 6), ("EdgeDel", 6, 5), ("EdgeAdd", 4, 4), ("VertexAdd", 9, None), ("VertexDel", 0, None), ("1", 3, None)]
    s.apply(updates(spark, rows).unionByName(spark.createDataFrame([("VertexLabelMod", 1, None, 0, "colour", "red")], UPDATE)), 0)
    assert sorted(map(tuple, s.snapshot(0).edges.collect())) == [(1, 2)]
    assert [tuple(r) for r in s.labels().collect()] == [(1, None, "colour", "red")]
    assert s.totals().where("ts = 0").first()["removed"] == 1


def test_differences_of_snapshots(spark):
    rng = random.Random(3)
    every = list(combinations(range(7), 2))
    before, after = set(rng.sample(every, 12)), set(rng.sample(every, 12))
    table = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    g0, g1 = Graph(table(before)), Graph(table(after))
    added, removed = table(after - before), table(before - after)
    for k in (3, 4):
        rows = changes.clique_changes(g1, g0, added, removed, k)
        n = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        count = lambda g: mining.kclique_count(g, k).first()["found"]  # noqa: B023, E731
        assert n.get("add", 0) - n.get("del", 0) == count(g1) - count(g0)
        delta = {r["pattern_id"]: r["delta"] for r in changes.motif_delta(changes.motif_changes(g1, g0, added, removed, k)).collect()}
        census = lambda g: {r["pattern_id"]: r["cnt"] for r in mining.motif_census(g, k).collect()}  # noqa: B023, E731
        c0, c1 = census(g0), census(g1)
        assert delta == {i: d for i in c0.keys() | c1.keys() if (d := c1.get(i, 0) - c0.get(i, 0))}


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    make = lambda: GraphStream(spark, str(tmp_path / "g"), output=lambda df, epoch: seen.append(epoch))
    make().preload(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    read = lambda: spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(source))
    for part in (TRACE[:3], TRACE[3:]):
        for rows in part:
            updates(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
            make().start(read()).awaitTermination()
    assert seen == [0, 1, 2, 3, 4]
    last = make().totals().orderBy(F.desc("ts")).first()
    assert (last["ts"], last["total"]) == (4, 1)


def test_replay_batches(spark):
    e = spark.createDataFrame([(i, i + 1 + j) for i in range(20) for j in range(3)], "src long, dst long")
    got = replay_batches(e, 7, 10).orderBy("src", "dst").collect()
    assert [r["batch"] for r in got] == [0] * 10 + [i // 7 + 1 for i in range(50)]
    shuffled = replay_batches(e, 7, 10, seed=1)
    assert sorted(r["batch"] for r in shuffled.collect()) == sorted(r["batch"] for r in got)


def brute_keyword(edges, k):
    found, ids = set(), sorted({v for e in edges for v in e})
    for n in range(3, k + 1):
        for s in combinations(ids, n):
            held = [v & 31 for v in s if v & 31 < 3]
            if sorted(held) != [0, 1, 2]:
                continue
            seen, todo = {s[0]}, [s[0]]
            while todo:
                v = todo.pop()
                for w in s:
                    if w not in seen and (min(v, w), max(v, w)) in edges:
                        seen.add(w)
                        todo.append(w)
            if len(seen) == n:
                found.add(s)
    return found


def test_keyword_color_and_pattern_changes(spark):
    rng = random.Random(11)
    ids = [0, 1, 2, 3, 4, 32, 33]
    every = list(combinations(ids, 2))
    before, after = set(rng.sample(every, 10)), set(rng.sample(every, 11))
    table = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    args = (Graph(table(after)), Graph(table(before)), table(after - before), table(before - after))
    rows = changes.keyword_changes(*args, 4, mining.keyword_label, 3).collect()
    was, now = brute_keyword(before, 4), brute_keyword(after, 4)
    got = {(tuple(r["vertices"]), r["status"]) for r in rows}
    inside = lambda s, e: {p for p in combinations(s, 2) if p in e}
    assert got == {(s, "add") for s in now - was} | {(s, "del") for s in was - now} | {(s, "mod") for s in was & now if inside(s, before) != inside(s, after)}
    wedge = changes.pattern_changes(*args, mining.PatternQuery(3, match=lambda vs, mask: F.bit_count(mask) == 2))
    n = {r["status"]: r["n"] for r in wedge.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = lambda e: sum(len(inside(s, e)) == 2 for s in combinations(ids, 3))
    assert n.get("add", 0) - n.get("del", 0) == count(after) - count(before)


def test_miner(spark, tmp_path, capsys):
    import numpy as np

    from motifloom.__main__ import main
    from motifloom.api import GraphMiner

    edges = [(0, 1), (0, 2), (1, 2), (2, 3)]
    np.array([e for a, b in edges for e in ((a, b), (b, a))], "<u4").tofile(tmp_path / "g")
    m = GraphMiner(spark, str(tmp_path / "m"), 3, 2)
    m.set_graph_input_files(str(tmp_path / "g"))
    assert m.mine().first()["found"] == 1
    seen = []
    m.set_output_callback(lambda df, t: seen.append((t, sorted((tuple(r["vertices"]), r["status"]) for r in df.collect()))))
    m.start()
    m.vertex_new(9)
    m.edge_new(1, 3)
    m.edge_new(0, 3)
    m.edge_del(0, 3)
    m.vertex_label_is(1, "k", "v")
    assert m.flush() == 0
    m.unset_output_callback()
    m.vertex_del(2)
    m.flush()
    assert seen == [(0, [((1, 2, 3), "add")])]
    assert [(r["ts"], r["total"]) for r in m.totals().orderBy("ts").collect()] == [(-1, 1), (0, 2), (1, 0)]
    m.stop()
    np.array([0, 2, 4, 7], "<u8").tofile(tmp_path / "off")
    (tmp_path / "more").write_text("1 3\n0 3\n")
    (tmp_path / "meta").write_text("vertices=4\n")
    for kind in (["-a", "3", "-k", "4"], ["-b", "5", "-u", "1", "-o", str(tmp_path / "a")], ["-b", "3", "-r", "-o", str(tmp_path / "r")], ["-i", "-k", "4", "-n", "4", "-m", "-M", str(tmp_path / "meta")],
                 ["-k", "4", "-i", "-b", "2", "-p", str(tmp_path / "more"), "-o", str(tmp_path / "p")]):
        main(["-f", str(tmp_path / "g"), *kind])
    out = capsys.readouterr().out
    assert "total" in out and "cache_hits" in out
    for wrong in (["-n", "3"], ["-d", str(tmp_path / "off")]):
        with pytest.raises(SystemExit):
            main(["-f", str(tmp_path / "g"), *wrong])


def graphs(spark, rng, ids, n):
    """Two random graphs and what they differ by, as arguments of the changes, and as sets."""
    every = list(combinations(ids, 2))
    before, after = set(rng.sample(every, n)), set(rng.sample(every, n + 2))
    table = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    return (Graph(table(after)), Graph(table(before)), table(after - before), table(before - after)), before, after


OWN = {
    "pfilter": mining.PatternQuery(3, pfilter=lambda vs, c: F.abs(vs[-1] - c) <= 3 if vs else c != 2),
    "filter": mining.PatternQuery(4, filter=lambda vs, mask: F.bit_count(mask) <= len(vs), match=lambda vs, mask: vs[1] < vs[2]),
    "symmetric": mining.PatternQuery(4, symmetric=True, pfilter=lambda vs, c: c % 5 != 4),
    "python": mining.PatternQuery(3, python_match=lambda b: (b["v1"] - b["v0"]) % 2 == b["mask"] % 2),
}


@pytest.mark.parametrize("name", OWN)
def test_own_queries_are_the_differences_of_static_runs(spark, name):
    own, k = OWN[name], OWN[name].k
    args, before, after = graphs(spark, random.Random(8), range(8), 20 if own.symmetric else 14)
    found = lambda g: {tuple(sorted(r[:k])) for r in own.rows(g).collect()}
    now, was = found(args[0]), found(args[1])
    rows = changes.pattern_changes(*args, own).collect()
    inside = lambda s, e: {p for p in combinations(s, 2) if p in e}
    assert {(tuple(r["vertices"]), r["status"]) for r in rows} == {(s, "add") for s in now - was} | {(s, "del") for s in was - now} | {(s, "mod") for s in was & now if inside(s, before) != inside(s, after)}
    assert now - was and was - now
    for r in rows:
        edges = {(r["vertices"][j], r["vertices"][i]) for i in range(k) for j in range(i) if r["new_edges"] >> (i * (i - 1) // 2 + j) & 1}
        assert edges == (inside(r["vertices"], after) - before if r["status"] != "del" else set())


def test_own_queries_streamed(spark, tmp_path):
    from motifloom.api import GraphMiner

    path = [(1, 2), (2, 3), (3, 50)]
    calls = []
    for i, own in enumerate((mining.PatternQuery(3, pfilter=lambda vs, c: c < 10, init=lambda: calls.append("init"), pupdate=lambda a, r, t: calls.append((a.count(), r.count(), t)), output=lambda df: calls.append(df.count())), mining.PatternQuery(3, symmetric=True))):
        m = GraphMiner(spark, str(tmp_path / str(i)), algorithm=own)
        m.start()
        m.batch_new([("EdgeAdd", a, b, 0, None, None) for a, b in path])
        static = own.rows(Graph.from_pairs(spark.createDataFrame(path, "src long, dst long"))).count()
        assert m.totals().where("ts = 0").first()["total"] == static == 1 - i
    assert calls == ["init", (3, 0, 0), 1]
    row = m.batches().first()
    assert (row["edges_added"], row["edges_removed"], row["changes"], row["epoch"]) == (3, 0, 0, 0) and row["seconds"] > 0


def test_cliques_tell_their_new_edges(spark):
    for seed in range(2):
        args, before, after = graphs(spark, random.Random(seed), range(7), 13)
        for k in (2, 3, 4, 5):
            cliques = lambda e: {s for s in combinations(range(7), k) if all(p in e for p in combinations(s, 2))}  # noqa: B023, E731
            want = {(s, "add", frozenset(set(combinations(s, 2)) - before)) for s in cliques(after) - cliques(before)} | {(s, "del", frozenset()) for s in cliques(before) - cliques(after)}
            got = {(tuple(r["vertices"]), r["status"], frozenset((r["vertices"][j], r["vertices"][i]) for i in range(k) for j in range(i) if r["new_edges"] >> (i * (i - 1) // 2 + j) & 1)) for r in changes.clique_changes(*args, k).collect()}
            assert got == want


def test_kept_triangles(spark):
    for seed in range(2):
        args, before, after = graphs(spark, random.Random(20 + seed), range(7), 15)
        kept = mining.triangles(args[1]).select(F.array("a", "b", "c").alias("vertices"))
        triangles, rows = changes.cached_clique4_changes(*args, kept)
        plain = {tuple(map(str, r)) for r in changes.clique_changes(*args, 4).collect()}
        got = rows.collect()
        assert {tuple(map(str, r[:4])) for r in got} == plain and all(r["cached"] == (r["new_edges"].bit_count() == 1) for r in got if r["status"] == "add")
        assert triangles.count() == changes.clique_changes(*args, 3).count()


def test_kept_distances(spark, tmp_path):
    rng, ids = random.Random(5), [*range(10), 32, 33, 34, 40]
    s = GraphStream(spark, str(tmp_path / "g"), k=4, kind="keyword", hops=2)
    s.preload(spark.createDataFrame(rng.sample(list(combinations(ids, 2)), 12), "src long, dst long"))
    for epoch in range(2):
        rows = [(rng.choice(["EdgeAdd", "EdgeDel"]), *p) for p in rng.sample(list(combinations(ids, 2)), 14)] + ([("VertexDel", 3, None)] if epoch == 1 else [])
        s.apply(updates(spark, rows), epoch)
        want = {tuple(r) for r in mining.keyword_distances(s.snapshot(epoch), 2).collect()}
        assert {tuple(r) for r in s.distances().collect()} == want
        assert s.totals().where(F.col("ts") == epoch).first()["total"] == mining.keyword_sets(s.snapshot(epoch), 4).count()


def test_labels_change_colours(spark, tmp_path):
    s = GraphStream(spark, str(tmp_path / "g"), kind="color", label_key="c")
    s.preload(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)], "src long, dst long"))
    label = lambda rows: spark.createDataFrame([("VertexLabelMod", v, None, 0, "c", str(x)) for v, x in rows] + [("VertexLabelMod", 0, None, 0, "other", "9"), ("EdgeLabelMod", 0, 1, 0, "c", "7")], UPDATE)
    s.apply(label([(0, 1), (1, 2), (2, 3)]), 0)
    s.apply(label([(3, 1)]).unionByName(updates(spark, [("EdgeDel", 0, 1)])), 1)
    s.apply(label([(3, 2)]), 2)
    assert [(r["added"], r["removed"], r["total"]) for r in s.totals().orderBy("ts").collect()] == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (0, 1, 0)]
    with pytest.raises(ValueError, match="label_key"):
        GraphStream(spark, "x", kind="keyword", label_key="c")


def test_new_labels_for_all_need_no_nested_loop(spark, monkeypatch):
    """edges are found by either end's id through equal keys, however many vertices have new labels."""
    plans = []
    real = changes.pinned
    monkeypatch.setattr(changes, "pinned", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(150)}
    new = set(rng.sample(sorted(edges), 20))
    old_labels, new_labels = ({v: rng.randrange(3) for v in range(30) if rng.random() < 0.9} for _ in range(2))
    df = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    table = lambda labels: spark.createDataFrame(sorted(labels.items()), "id long, label long")
    lost = set(rng.sample(sorted(edges - new), 15))
    before, after = edges - new, edges - lost
    rows = changes.labelled_clique_changes(Graph(df(after)), Graph(df(before)), df(new), df(lost), 3, table(old_labels), table(new_labels)).collect()
    held = lambda e, labels: {t for t in combinations(range(30), 3) if set(combinations(t, 2)) <= e and {labels.get(v) for v in t} == {0, 1, 2}}
    was, now = held(before, old_labels), held(after, new_labels)
    assert {(tuple(r["vertices"]), r["status"]) for r in rows} == {(t, "add") for t in now - was} | {(t, "del") for t in was - now}
    for r in rows:  # bits of ab, ac, bc
        fresh = [p in new for p in combinations(r["vertices"], 2)]
        assert r["new_edges"] == (sum(x << i for i, x in enumerate(fresh)) if r["status"] == "add" else 0)
    assert len(rows) == len(was ^ now) > 5 and plans and not any("NestedLoop" in p for p in plans)


def test_distances_keep_no_pairs_of_vertices(spark, monkeypatch):
    """among the leaves of a hub, a hop has rows for vertices and keywords, not for pairs of vertices."""
    sizes = []
    real = changes.pinned

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(changes, "pinned", counted)
    g = Graph(spark.range(1, 301).selectExpr("0L as src", "id as dst"))
    vertices = spark.range(301).withColumnRenamed("id", "v")
    for hops in (1, 2, 3):
        got = changes.distances_near(g, vertices, hops, mining.keyword_label, 3)
        want = mining.keyword_distances(g, hops)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(sizes) <= 2 * 300 + 301


def test_seeds_that_fit_no_keyword_set_are_left_out(spark, monkeypatch):
    """an edge of two plain vertices, or of one keyword twice, is in no set of four."""
    seeds = []
    real = changes.pattern_changes

    def seen(*args):
        seeds.append({tuple(r)[:2] for r in args[6].collect()})
        return real(*args)

    monkeypatch.setattr(changes, "pattern_changes", seen)
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    before, new = [(0, 1), (1, 2), (0, 32)], [(3, 4), (0, 3), (0, 64), (2, 64), (1, 4)]
    rows = changes.keyword_changes(Graph(table(before + new)), Graph(table(before)), table(new), table([]), 4, mining.keyword_label, 3).collect()
    want = brute_keyword(set(before + new), 4) - brute_keyword(set(before), 4)
    assert {tuple(r["vertices"]) for r in rows if r["status"] == "add"} == want and len(want) > 2
    assert len(seeds) == 2 and all(s <= {(0, 3), (2, 64), (1, 4)} for s in seeds) and not seeds[0] & {(0, 3), (1, 4)}
