"""The graph queries over the bundled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.api import GraphMiner
from motifloom.functions import masks
from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.plans import expand
from motifloom.plans.cut import pinned, shared_folder
from motifloom.sources import files
from motifloom.sql import ORACLE
from motifloom.streaming import changes
from motifloom.streaming.runner import UPDATE, GraphStream, replay_batches

#: The replays begin with half of the edges; the others come in so many batches.
EPOCHS = 4


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts returned from one order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    pairs = lines.withColumnRenamed("l_partkey", "src").join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst")
    return Graph.from_pairs(pairs)


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers of consecutive orders. The orders lie in ranges of keys; the first of a range follows the last of the one before."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    o = o.withColumn("r", F.expr("o_orderkey div 65536"))
    own = Window.partitionBy("r").orderBy("o_orderkey")
    firsts = o.groupBy("r").agg(F.min_by("o_custkey", "o_orderkey").alias("c"))  # one row for 65536 keys
    after = firsts.select("r", F.lead("c").over(Window.partitionBy(F.lit(0)).orderBy("r")).alias("next_first"))
    led = o.withColumn("next", F.lead("o_custkey").over(own)).join(after, "r").select(F.col("o_custkey").alias("src"), F.coalesce("next", "next_first").alias("dst"))
    return Graph.from_pairs(led)


def count(df: DataFrame, name: str = "found") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def edges_copurchase_returned(spark, sf_dir):
    return copurchase(spark, sf_dir).edges


def edges_customer_chain(spark, sf_dir):
    return chain(spark, sf_dir).edges


def degree(spark, sf_dir):
    return copurchase(spark, sf_dir).degree()


def degree_histogram(spark, sf_dir):
    return copurchase(spark, sf_dir).degree().groupBy("degree").agg(F.count(F.lit(1)).alias("n_vertices"))


def adjacency_size(spark, sf_dir):
    nb = copurchase(spark, sf_dir).adjacency()
    return nb.select("v", F.size("nb").cast("long").alias("n"), F.aggregate("nb", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_nb"), F.col("nb")[0].alias("first_nb"))


def forward_edges(spark, sf_dir):
    return copurchase(spark, sf_dir).forward().groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


def backward_edges(spark, sf_dir):
    return copurchase(spark, sf_dir).backward().groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"))


def in_degree_offsets(spark, sf_dir):
    """Backward degrees and where each vertex's slice begins: prefix sums in ranges of ids, and over the ranges."""
    d = copurchase(spark, sf_dir).backward().groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.expr("v div 4096"))
    own = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy("r").agg(F.sum("n").alias("m"))
    base = ranges.withColumn("b", F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.withColumn("o", F.coalesce(F.sum("n").over(own), F.lit(0))).join(base, "r").select("v", "n", (F.col("o") + F.col("b")).alias("off"))


def has_edge_probe(spark, sf_dir):
    g = copurchase(spark, sf_dir)
    v = g.degree().select(F.col("v").alias("a"))
    probes = v.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 50)))
    return g.has_edges(probes)


def has_edge_ts_probe(spark, sf_dir):
    """The batch of each probed edge that is there as of batch 2."""
    g = timed(spark, sf_dir).snapshot(2)
    v = copurchase(spark, sf_dir).degree().select(F.col("v").alias("src"))
    probes = v.withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.col("src") + 50)))
    return g.edge_ts(probes, "src", "dst").select("src", "dst", F.col("add_ts").alias("ts"))


def neighbours_ts(spark, sf_dir):
    """By vertex, its neighbours as of batch 2, those above and below it, and the batches of their edges."""
    g, out = timed(spark, sf_dir).snapshot(2), None
    for name, view in (("all", g.symmetric(ts=True)), ("above", g.forward(ts=True)), ("below", g.backward(ts=True))):
        rows = view.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_u"), F.sum("add_ts").alias("sum_ts")).withColumn("side", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _binary(spark, sf_dir) -> str:
    folder = shared_folder(spark, "graph")
    files.write_binary(copurchase(spark, sf_dir), folder)
    return folder


def binary_edges_read(spark, sf_dir):
    """The edges in both directions, written as a binary list and read in slices: by vertex, the first and last position, neighbours."""
    e = files.binary_edges(spark, f"{_binary(spark, sf_dir)}/edges", split=4096)
    return e.groupBy(F.col("src").alias("v")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("dst").alias("sum_u"))


def binary_offsets_read(spark, sf_dir):
    """The offsets of the binary list, and how many of its vertices disagree with them."""
    folder = _binary(spark, sf_dir)
    off = files.binary_offsets(spark, f"{folder}/offsets")
    wrong = files.misplaced(files.binary_edges(spark, f"{folder}/edges"), off)
    return off.select("v", "off").unionByName(count(wrong, "off").select(F.lit(-1).cast("long").alias("v"), "off"))


def binary_graph_triangles(spark, sf_dir):
    return mining.kclique_count(files.binary_graph(spark, f"{_binary(spark, sf_dir)}/edges"), 3)


def text_edges_read(spark, sf_dir):
    """The edges, written as text in the other direction, with lines that aren't edges between them."""
    folder = shared_folder(spark, "text")
    lines = copurchase(spark, sf_dir).edges.select(F.explode(F.array(F.concat_ws("\t", "dst", "src"), F.concat(F.lit("# "), F.col("src")), F.concat_ws("  ", "src", "src"))).alias("value"))
    lines.write.text(folder)
    return files.text_graph(spark, folder).edges


def metadata_read(spark, sf_dir):
    folder = shared_folder(spark, "metadata")
    most = copurchase(spark, sf_dir).edges.agg(F.max("dst").alias("m"))
    most.select(F.explode(F.array(F.lit("name=x"), F.concat(F.lit("vertices="), F.col("m") + 1))).alias("value")).write.text(folder)
    return spark.range(1).select(F.lit(files.metadata_vertices(spark, folder)).cast("long").alias("vertices"))


def triangle_count(spark, sf_dir):
    return mining.kclique_count(copurchase(spark, sf_dir), 3)


def triangle_count_chain(spark, sf_dir):
    return mining.kclique_count(chain(spark, sf_dir), 3)


def triangle_list(spark, sf_dir):
    return mining.triangles(copurchase(spark, sf_dir))


def triangle_per_vertex(spark, sf_dir):
    return mining.triangles_per_vertex(copurchase(spark, sf_dir))


def triangle_per_edge(spark, sf_dir):
    return mining.triangles_per_edge(copurchase(spark, sf_dir))


def kclique3_count(spark, sf_dir):
    return mining.kclique_count(copurchase(spark, sf_dir), 3)


def kclique4_count(spark, sf_dir):
    return mining.kclique_count(copurchase(spark, sf_dir), 4)


def kclique5_count(spark, sf_dir):
    return mining.kclique_count(copurchase(spark, sf_dir), 5)


def kclique4_list(spark, sf_dir):
    return mining.kclique_list(copurchase(spark, sf_dir), 4)


def color_clique3(spark, sf_dir):
    return mining.color_clique_count(copurchase(spark, sf_dir), 3)


def color_clique4(spark, sf_dir):
    return mining.color_clique_count(copurchase(spark, sf_dir), 4)


def motif3(spark, sf_dir):
    return mining.motif_census(copurchase(spark, sf_dir), 3)


def motif4(spark, sf_dir):
    return mining.motif_census(copurchase(spark, sf_dir), 4)


def motif5_by_edges(spark, sf_dir):
    """Connected sets of five parts of the smaller ids, by their patterns' edges: the pattern's mask has as many bits as the sets' have."""
    few = Graph(copurchase(spark, sf_dir).edges.where("dst % 4 = 0 and src % 4 = 0"))
    rows = mining.motif_census(few, 5)
    return rows.groupBy(F.bit_count("pattern_id").alias("n_edges")).agg(F.sum("cnt").alias("cnt"))


def motif6_by_edges(spark, sf_dir):
    few = Graph(copurchase(spark, sf_dir).edges.where("dst % 8 = 0 and src % 8 = 0"))
    return mining.motif_census(few, 6).groupBy(F.bit_count("pattern_id").alias("n_edges")).agg(F.sum("cnt").alias("cnt"))


def motif3_closed_form(spark, sf_dir):
    return mining.motif3_closed(copurchase(spark, sf_dir))


def motif4_closed_form(spark, sf_dir):
    return mining.motif4_closed(copurchase(spark, sf_dir))


def distinct_patterns(spark, sf_dir):
    return motif4(spark, sf_dir).agg(F.countDistinct("pattern_id").alias("n_patterns"))


def induced_by_edges(spark, sf_dir):
    """motif4 where sets meet neighbours in parts: the plan for graphs with hubs."""
    rows = expand.induced_counts(copurchase(spark, sf_dir), 4)
    return rows.groupBy(masks.degree_id(F.col("mask"), 4).alias("pattern_id")).agg(F.sum("n").alias("cnt"))


def bfs_level_counts(spark, sf_dir):
    return mining.level_counts(copurchase(spark, sf_dir), 3)


def clique4_from_triangles(spark, sf_dir):
    return mining.clique4_from_triangles(copurchase(spark, sf_dir))


def keyword_dist_2hop(spark, sf_dir):
    return mining.keyword_distances(copurchase(spark, sf_dir), 2)


def keyword_dist_lines(spark, sf_dir):
    return mining.distance_lines(mining.keyword_distances(copurchase(spark, sf_dir), 2))


def part_sizes(spark, sf_dir) -> DataFrame:
    """A table of labels: the size class of a part, without those of size 50."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 50").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") % 3).cast("long").alias("label"))


def labelled_color_clique3(spark, sf_dir):
    """Triangles of parts of three size classes, by a table of labels."""
    return mining.color_clique_count(Graph(copurchase(spark, sf_dir).edges, part_sizes(spark, sf_dir)), 3)


def labelled_keyword_k3(spark, sf_dir):
    """Connected sets of three parts, one of each size class, by a table of labels."""
    few = copurchase(spark, sf_dir).edges.where("src % 4 = 0 and dst % 4 = 0")
    sets = mining.keyword_sets(Graph(few, part_sizes(spark, sf_dir)), 3)
    return sets.select(F.array_join(F.col("vertices").cast("array<string>"), "-").alias("vertices"))


def _keyword(spark, sf_dir, mode):
    sets = mining.keyword_sets(copurchase(spark, sf_dir), 4, mode)
    return sets.select(F.array_join(F.col("vertices").cast("array<string>"), "-").alias("vertices"))


def keyword_cover_k4(spark, sf_dir):
    return _keyword(spark, sf_dir, "cover")


def keyword_minimal_k4(spark, sf_dir):
    return _keyword(spark, sf_dir, "minimal")


def active_seeds_k4(spark, sf_dir):
    return copurchase(spark, sf_dir).seeds(3)


def kcore_prune(spark, sf_dir):
    return copurchase(spark, sf_dir).core(6).edges


def history(spark, sf_dir) -> DataFrame:
    """The copurchase edges with the batch in which a replay adds them, pinned."""
    e = pinned(copurchase(spark, sf_dir).edges)
    m = e.count()
    return pinned(replay_batches(e, max(1, -(-(m - m // 2) // EPOCHS)), m // 2))


def timed(spark, sf_dir) -> Graph:
    e = history(spark, sf_dir)
    return Graph.from_history(e.select("src", "dst", F.col("batch").alias("add_ts"), F.lit(None).cast("long").alias("del_ts")))


def shuffled_replay_sizes(spark, sf_dir):
    """Batch sizes where the edges come in the order of a hash, and how many edges came."""
    e = pinned(copurchase(spark, sf_dir).edges)
    m = e.count()
    rows = replay_batches(e, max(1, -(-(m - m // 2) // EPOCHS)), m // 2, seed=5)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def replay_batch_sizes(spark, sf_dir):
    return history(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("sum_src"))


def snapshot_asof(spark, sf_dir):
    """Edges alive as of epoch 2, if each edge added in epoch t with even src + dst goes in epoch t + 2."""
    e = history(spark, sf_dir)
    gone = F.when((F.col("src") + F.col("dst")) % 2 == 0, F.col("batch") + 2)
    return Graph.from_history(e.select("src", "dst", F.col("batch").alias("add_ts"), gone.alias("del_ts"))).snapshot(2).edges.select("src", "dst", "add_ts")


def _epochs(spark, sf_dir, evaluate) -> DataFrame:
    """evaluate(after, before, added) of each insert epoch, from the graph of the epochs before."""
    e = history(spark, sf_dir)
    out = None
    for t in range(1, EPOCHS + 1):
        rows = evaluate(Graph(e.where(F.col("batch") <= t).select("src", "dst")), Graph(e.where(F.col("batch") < t).select("src", "dst")), e.where(F.col("batch") == t)).withColumn("ts", F.lit(t).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def delta_triangles_by_batch(spark, sf_dir):
    none = lambda g: g.edges.limit(0)
    return _epochs(spark, sf_dir, lambda after, before, added: count(changes.clique_changes(after, before, added, none(before), 3)))


def delta_clique4_by_batch(spark, sf_dir):
    none = lambda g: g.edges.limit(0)
    return _epochs(spark, sf_dir, lambda after, before, added: count(changes.clique_changes(after, before, added, none(before), 4)))


def delta_motif3_by_batch(spark, sf_dir):
    none = lambda g: g.edges.limit(0)
    return _epochs(spark, sf_dir, lambda after, before, added: changes.motif_delta(changes.motif_changes(after, before, added, none(before), 3)))


def delete_triangles_by_batch(spark, sf_dir):
    """The whole graph is there; the batches go one after another."""
    e = history(spark, sf_dir)
    out = None
    for t in range(1, EPOCHS + 1):
        gone = lambda upto: (F.col("batch") >= 1) & (F.col("batch") <= upto)
        before, after = (Graph(e.where(~gone(x)).select("src", "dst")) for x in (t - 1, t))
        rows = count(changes.clique_changes(after, before, e.limit(0), e.where(F.col("batch") == t), 3)).withColumn("ts", F.lit(t).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def clique_changes_mixed(spark, sf_dir):
    """An epoch adds the last batch and deletes the first: how many triangles come and go."""
    e = history(spark, sf_dir)
    first, last = F.col("batch") == 1, F.col("batch") == EPOCHS
    before, after = (Graph(e.where(~x).select("src", "dst")) for x in (last, first))
    return changes.clique_changes(after, before, e.where(last), e.where(first), 3).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def running_total(spark, sf_dir):
    """Triangles by the batch that completes them, and so far."""
    e = history(spark, sf_dir)
    t = mining.triangles(Graph(e.select("src", "dst")))
    for x, y in ("ab", "ac", "bc"):
        t = t.join(e.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("batch").alias(f"b{x}{y}")), [x, y])
    per = t.groupBy(F.greatest("bab", "bac", "bbc").alias("ts")).agg(F.count(F.lit(1)).alias("found"))
    return changes.with_totals(per, "found").select("ts", "found", F.col("total").cast("long").alias("total"))


def clique_new_edges(spark, sf_dir):
    """The triangles that each epoch completes, by how many of their edges are new."""
    none = lambda g: g.edges.limit(0)
    rows = _epochs(spark, sf_dir, lambda after, before, added: changes.clique_changes(after, before, added, none(before), 3))
    return rows.groupBy("ts", masks.n_edges(F.col("new_edges")).alias("n_new")).agg(F.count(F.lit(1)).alias("n"))


def embedding_functions(spark, sf_dir):
    """The triangles that the last epoch completes, as embeddings: a line for people, old degrees, what is left of two vertices, and that with an edge more."""
    e = history(spark, sf_dir)
    g = lambda upto: Graph(e.where(F.col("batch") <= upto).select("src", "dst"))
    rows = changes.clique_changes(g(EPOCHS), g(EPOCHS - 1), e.where(F.col("batch") == EPOCHS), e.limit(0), 3)
    vs, mask, new = F.col("vertices"), F.col("edges"), F.col("new_edges")
    two, left = masks.truncate(vs, mask, 2)
    old = [masks.old_degree(mask, new, i, 3).alias(f"old{i}") for i in range(3)]
    return rows.select(masks.describe(vs, mask, new, 3).alias("line"), *old, masks.has(new, 2, 1).alias("bc_new"), F.size(two).alias("n_left"), left.alias("left_mask"), masks.connect(left, 2, 0, masks.has(new, 2, 0)).cast("int").alias("connected"))


def miner_static(spark, sf_dir):
    """The four algorithms by number, on a binary file."""
    folder, out = _binary(spark, sf_dir), None
    for number in (0, 1, 2, 3):
        m = GraphMiner(spark, k=3, algorithm=number)
        m.set_graph_input_files(f"{folder}/edges")
        found = m.mine()
        found = found.select("pattern_id", "cnt") if number == 1 else found.select(F.lit(0).alias("pattern_id"), F.col("found").alias("cnt")) if number in (0, 2) else count(found, "cnt").select(F.lit(0).alias("pattern_id"), "cnt")
        rows = found.select(F.lit(number).alias("algorithm"), F.col("pattern_id").cast("int").alias("pattern_id"), "cnt")
        out = rows if out is None else out.unionByName(rows)
    return out


def miner_stream(spark, sf_dir):
    """A program that sends batches and gets changes back: what its callback saw, by epoch and status, and the same of the table of matches."""
    e, seen, folder = history(spark, sf_dir), [], shared_folder(spark, "miner")
    m = GraphMiner(spark, folder, 4)
    m.graph = Graph(e.where("batch = 0").select("src", "dst"))
    m.set_output_callback(lambda df, epoch: seen.extend((epoch, r["status"], r["n"], "callback") for r in df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()))
    m.start()
    for t in range(1, EPOCHS):
        m.batch_new(_update(e.where(F.col("batch") == t)))
    m.batch_new(_update(e.where("batch = 1"), "EdgeDel"))
    table = spark.read.parquet(f"{folder}/changes").groupBy(F.col("epoch").cast("long").alias("epoch"), "status").agg(F.count(F.lit(1)).alias("n")).withColumn("seen_by", F.lit("table"))
    m.stop()
    return spark.createDataFrame(seen, "epoch long, status string, n long, seen_by string").unionByName(table)


def _update(rows: DataFrame, kind: str = "EdgeAdd", dst: str = "dst", key: str | None = None, value: str = "cast(null as string)") -> DataFrame:
    return rows.selectExpr(f"'{kind}' as tpe", "src", f"{dst} as dst", "cast(0 as long) as ts", f"{repr(key) if key else 'cast(null as string)'} as key", f"{value} as value")


def _replayed(spark, sf_dir, **options) -> GraphStream:
    """The replay as a stream: each batch's files arrive and a micro-batch takes them. Epoch -1 is the preloaded half."""
    e = history(spark, sf_dir)
    folder = shared_folder(spark, "stream")
    stream = GraphStream(spark, f"{folder}/state", **options)
    stream.preload(e.where("batch = 0"))
    for t in range(1, EPOCHS + 1):
        _update(e.where(F.col("batch") == t)).write.mode("append").parquet(f"{folder}/in")
        stream.start(spark.readStream.schema(UPDATE).parquet(f"{folder}/in")).awaitTermination()
    return stream


def stream_replay_triangles(spark, sf_dir):
    return _replayed(spark, sf_dir).totals().select("ts", "added", "removed", "total")


def stream_color(spark, sf_dir):
    return _replayed(spark, sf_dir, kind="color").totals().select("ts", "added", "removed", "total")


def stream_keyword(spark, sf_dir):
    """Keyword sets of up to four parts as the graph grows, and at last the kept distances: as many as there are of each length (ts 100 and on)."""
    stream = _replayed(spark, sf_dir, kind="keyword", k=4, hops=2)
    kept = stream.distances().groupBy((F.col("d") + 100).cast("long").alias("ts")).agg(F.count(F.lit(1)).alias("total"))
    return stream.totals().select("ts", "total").unionByName(kept)


def stream_kept_triangles(spark, sf_dir):
    """4-cliques from triangles that are kept across epochs; hits are those that only needed kept ones to be closed."""
    stream = _replayed(spark, sf_dir, k=4, keep_triangles=True)
    return stream.batches().select(F.col("epoch").alias("ts"), "edges_added", "changes", "cache_hits")


def stream_pfilter(spark, sf_dir):
    """A query of one's own as the graph grows: connected triples of parts whose ids differ by 300 at most, the least being odd."""
    own = mining.PatternQuery(3, pfilter=lambda vs, c: F.abs(vs[0] - c) <= 300 if vs else c % 2 == 1)
    return _replayed(spark, sf_dir, kind="pattern", query=own).totals().select("ts", "total")


def stream_symmetric(spark, sf_dir):
    """4-cliques whose ids differ by 1000 at most and add up to an even number, which only Python is asked, as the graph grows."""
    near = lambda vs, c: F.abs(vs[0] - c) <= 1000 if vs else F.lit(True)
    own = mining.PatternQuery(4, pfilter=near, symmetric=True, python_match=lambda b: (b["v0"] + b["v1"] + b["v2"] + b["v3"]) % 2 == 0)
    return _replayed(spark, sf_dir, kind="pattern", query=own).totals().select("ts", "total")


def stream_vertex_del(spark, sf_dir):
    """Triangles as the parts with an id divisible by 10 are deleted, and those divisible by 7 in the next epoch."""
    g = copurchase(spark, sf_dir)
    stream = GraphStream(spark, shared_folder(spark, "stream"))
    stream.preload(g.edges)
    v = g.degree().select(F.col("v").alias("src"))
    for epoch, n in enumerate((10, 7)):
        stream.apply(_update(v.where(F.col("src") % n == 0), "VertexDel", "cast(null as long)"), epoch)
    return stream.totals().select("ts", "added", "removed", "total")


def stream_relabel(spark, sf_dir):
    """Triangles of three size classes as labels arrive: first those of all parts, then every fifth part's moves on by one class."""
    stream = GraphStream(spark, shared_folder(spark, "stream"), kind="color", label_key="size")
    stream.preload(copurchase(spark, sf_dir).edges)
    size = part_sizes(spark, sf_dir).withColumnRenamed("id", "src")
    stream.apply(_update(size, "VertexLabelMod", "cast(null as long)", "size", "cast(label as string)"), 0)
    stream.apply(_update(size.where("src % 5 = 0"), "VertexLabelMod", "cast(null as long)", "size", "cast((label + 1) % 3 as string)"), 1)
    return stream.totals().select("ts", "added", "removed", "total")


def custom_pattern(spark, sf_dir):
    """Paths a-b-c of three vertices whose ends aren't adjacent and are both even, the middle being odd."""
    g = copurchase(spark, sf_dir)

    def match(vs, mask):
        middle = [masks.degree(mask, i, 3) == 2 for i in range(3)]
        right = [F.when(middle[i], vs[i] % 2 == 1).otherwise(vs[i] % 2 == 0) for i in range(3)]
        return (masks.n_edges(mask) == 2) & right[0] & right[1] & right[2]

    rows = mining.PatternQuery(3, match=match).run(g)
    return rows.select(F.array_sort(F.array("v0", "v1", "v2")).alias("s")).select(*(F.col("s")[i].alias(c) for i, c in enumerate("abc")))


def custom_symmetric(spark, sf_dir):
    """4-cliques of parts whose ids differ by 1000 at most, by filters that stop the search early."""
    near = lambda vs, c: F.abs(vs[0] - c) <= 1000 if vs else F.lit(True)
    return count(mining.PatternQuery(4, pfilter=near, symmetric=True).run(copurchase(spark, sf_dir)))


def embedding_masks(spark, sf_dir):
    """Masks of the three-vertex sets and their degrees."""
    rows = expand.induced(copurchase(spark, sf_dir), 3)
    return rows.groupBy("mask", masks.n_edges(F.col("mask")).alias("n_edges"), masks.degree(F.col("mask"), 0, 3).alias("d0")).agg(F.count(F.lit(1)).alias("cnt"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    edges_copurchase_returned, edges_customer_chain, degree, degree_histogram, adjacency_size, forward_edges, backward_edges, in_degree_offsets, has_edge_probe, has_edge_ts_probe,
    triangle_count, triangle_count_chain, triangle_list, triangle_per_vertex, triangle_per_edge, kclique3_count, kclique4_count, kclique5_count, kclique4_list, color_clique3, color_clique4,
    motif3, motif4, motif3_closed_form, motif4_closed_form, distinct_patterns, bfs_level_counts, clique4_from_triangles, keyword_dist_2hop, keyword_cover_k4, keyword_minimal_k4,
    active_seeds_k4, kcore_prune, replay_batch_sizes, snapshot_asof, delta_triangles_by_batch, delta_clique4_by_batch, delta_motif3_by_batch, delete_triangles_by_batch,
    clique_changes_mixed, running_total, stream_replay_triangles, custom_pattern, custom_symmetric, embedding_masks,
    neighbours_ts, binary_edges_read, binary_offsets_read, binary_graph_triangles, text_edges_read, metadata_read, shuffled_replay_sizes, motif5_by_edges, motif6_by_edges, induced_by_edges,
    keyword_dist_lines, labelled_color_clique3, labelled_keyword_k3, clique_new_edges, stream_color, stream_keyword, stream_kept_triangles, stream_pfilter, stream_symmetric, stream_vertex_del, stream_relabel,
    embedding_functions, miner_static, miner_stream,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
