"""python -m motifloom: static mining of a graph file, or a replay of it in batches."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motifloom.api import ALGORITHMS, GraphMiner
from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.sources import files
from motifloom.streaming.runner import replay_batches


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="motifloom", description=__doc__)
    p.add_argument("-f", "--file", required=True, help="the graph")
    p.add_argument("-F", "--format", default="binary", choices=("binary", "text", "parquet"))
    p.add_argument("-a", "--algorithm", type=int, default=0, choices=sorted(ALGORITHMS), help=", ".join(f"{n}: {x}" for n, x in ALGORITHMS.items()))
    p.add_argument("-k", type=int, default=3, help="vertices of a match")
    p.add_argument("-d", "--offsets", help="a binary file of offsets that the graph's must agree with")
    p.add_argument("-M", "--metadata", help="a text file with vertices=, the number of ids")
    p.add_argument("-n", "--vertices", type=int, help="the number of ids: none may be that or more")
    p.add_argument("-t", "--threads", type=int, help="cores, where no master is configured")
    p.add_argument("-b", "--batch", type=int, help="replay the edges in batches of so many")
    p.add_argument("-c", "-u", "--preload", type=int, default=0, help="edges that are there before the first batch")
    p.add_argument("-p", "--updates", help="a text file of two ids a line: the edges to replay, over the graph")
    p.add_argument("-r", "--remove", action="store_true", help="replay deletions: the whole graph is there, the first batches go")
    p.add_argument("-i", "--indexed", action="store_true", help="4-cliques from triangles, kept across batches")
    p.add_argument("-m", "--mmap", action="store_true", help="accepted: files are read in slices in any case")
    p.add_argument("-o", "--out", help="folder of the evolving graph")
    a = p.parse_args(args)
    builder = SparkSession.builder
    spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    m = GraphMiner(spark, a.out, a.k, a.algorithm)
    m.set_graph_input_files(a.file, a.format)
    if a.offsets and files.misplaced(files.binary_edges(spark, a.file), files.binary_offsets(spark, a.offsets)).take(1):
        p.error(f"{a.offsets} doesn't agree with {a.file}")
    most = a.vertices if a.vertices is not None else files.metadata_vertices(spark, a.metadata) if a.metadata else None
    if most is not None and m.graph.edges.where(F.col("dst") >= most).take(1):
        p.error(f"{a.file} has ids of {most} or more")
    if not a.batch:
        found = mining.clique4_from_triangles(m.graph) if a.indexed and (a.algorithm, a.k) == (0, 4) else m.mine()
        found.show(1000, truncate=False)
        return
    if a.updates:
        edges = replay_batches(Graph(files.clean(files.text_pairs(spark, a.updates))).edges, a.batch)
    else:
        edges = replay_batches(m.graph.edges, a.batch, 0 if a.remove else a.preload)
        m.graph = m.graph if a.remove else Graph(edges.where("batch = 0").select("src", "dst"))
    m.start(keep_triangles=a.indexed)
    first = edges.where("batch >= 1")
    for batch in sorted(r["batch"] for r in first.select("batch").distinct().collect()):
        rows = first.where(first["batch"] == batch)
        m.batch_new(rows.selectExpr(f"'{'EdgeDel' if a.remove else 'EdgeAdd'}' as tpe", "src", "dst", "0L as ts", "cast(null as string) as key", "cast(null as string) as value"))
    m.totals().orderBy("ts", "pattern_id").show(1000, truncate=False)
    m.batches().orderBy("epoch").show(1000, truncate=False)


if __name__ == "__main__":
    main()
