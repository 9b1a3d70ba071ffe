"""Evolving graphs: update batches by Structured Streaming, one epoch each.

The state is a log of effective changes by epoch, with a compacted base every few epochs; a snapshot is the base and the
log's last word on each edge. Everything an epoch writes is under its own number and replaced if the epoch runs again,
so a restart from the stream's checkpoint repeats nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.plans.cut import pinned
from motifloom.streaming import changes

UPDATE = "tpe string, src long, dst long, ts long, key string, value string"
LOG = "src long, dst long, alive boolean, epoch long"
BATCH = "seconds double, edges_added long, edges_removed long, changes long, cache_hits long"
LABELS = "src long, dst long, key string, value string, epoch long"
#: Names of the update types, and the numbers 0 to 5 that stand for them.
TYPES = ("VertexAdd", "VertexDel", "EdgeAdd", "EdgeDel", "VertexLabelMod", "EdgeLabelMod")


@dataclass
class GraphStream:
    """Keeps a graph's state in folder and evaluates a query after each batch of updates.

    k and kind (clique, motif, color, keyword or pattern) are the query; pattern takes query, all of whose hooks count (or match(vertices, mask)
    alone), color and keyword a label(vertex) other than the derived one, color also label_key, the key of the label updates whose values are
    the vertices' labels, so that such an update can make and unmake matches. output(changes, epoch) gets each epoch's changes besides the
    tables changes, totals and batches (seconds and counts of each epoch). keep_triangles: 4-cliques come from a table of triangles kept across
    epochs. hops: the table distances (keyword) is kept for so many. VertexAdd changes no edge; VertexDel deletes the vertex's edges; label updates are
    kept in the table labels. Of several updates to one edge in an epoch the greatest ts counts; at equal ts an addition and a deletion cancel each other.
    """

    spark: SparkSession
    folder: str
    k: int = 3
    kind: str = "clique"
    output: Callable[[DataFrame, int], None] | None = None
    compact_every: int = 16
    label: Callable[[Column], Column] | None = None
    match: Callable[[list[Column], Column], Column] | None = None
    query: mining.PatternQuery | None = None
    label_key: str | None = None
    keep_triangles: bool = False
    hops: int = 0

    def __post_init__(self) -> None:
        if self.kind == "pattern":
            self.query = self.query or mining.PatternQuery(self.k, match=self.match)
            self.k = self.query.k
        if self.label_key and self.kind != "color":
            raise ValueError("label_key is for color queries")
        if self.keep_triangles and (self.kind, self.k) != ("clique", 4):
            raise ValueError("triangles are kept for 4-cliques")
        self._kept: tuple[int, Graph] | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema.replace(", epoch long", "") + ", epoch long").parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def snapshot(self, epoch: int) -> Graph:
        """The graph as of the end of epoch."""
        base = self._table("base", "src long, dst long, epoch long").where(F.col("epoch") <= epoch)
        last = base.agg(F.max("epoch")).first()[0]
        log = self._table("log", LOG).where(F.col("epoch") <= epoch)
        if last is not None:
            log = log.where(F.col("epoch") > last).unionByName(base.where(F.col("epoch") == last).withColumn("alive", F.lit(True)))
        now = log.groupBy("src", "dst").agg(F.max_by("alive", "epoch").alias("alive"))
        return Graph(now.where("alive").select("src", "dst"))

    def _pinned(self, epoch: int) -> Graph:
        """snapshot(epoch), computed once; that of the last epoch asked for is kept for the next one."""
        self._kept = epoch, Graph(pinned(self.snapshot(epoch).edges))
        return self._kept[1]

    def preload(self, pairs: DataFrame) -> None:
        """The graph before the first batch, as epoch -1."""
        if self.query and self.query.init:
            self.query.init()
        self._put(Graph.from_pairs(pairs).edges, "base", -1)
        g = self._pinned(-1)
        self._put_totals(self._census(g), -1)
        if self.keep_triangles:
            self._put(mining.triangles(g).select(F.array("a", "b", "c").alias("vertices"), F.lit(True).alias("alive")), "triangles", -1)
        if self.hops:
            self._put(mining.keyword_distances(g, self.hops, self._label()), "distances", -1)

    def _label(self) -> Callable[[Column], Column]:
        return self.label or (mining.keyword_label if self.kind == "keyword" else lambda v: mining.colour(v, self.k))

    def _census(self, g: Graph) -> DataFrame:
        none = F.lit(0).cast("long")
        if self.kind == "motif":
            rows = mining.motif_census(g, self.k).select("pattern_id", F.col("cnt").alias("delta"))
        elif self.kind in ("clique", "color"):
            g = Graph(g.edges, self.vertex_labels(-1)) if self.label_key else g
            n = mining.kclique_count(g, self.k) if self.kind == "clique" else mining.color_clique_count(g, self.k, label=None if self.label_key else self._label())
            rows = n.select(F.lit(0).alias("pattern_id"), F.col("found").alias("delta"))
        else:
            found = mining.keyword_sets(g, self.k, label=self._label()) if self.kind == "keyword" else self.query.rows(g)
            rows = found.agg(F.count(F.lit(1)).alias("delta")).select(F.lit(0).alias("pattern_id"), "delta")
        return rows.withColumns({"added": none, "removed": none})

    def _changes(self, after: Graph, before: Graph, added: DataFrame, removed: DataFrame, epoch: int) -> DataFrame:
        args = (after, before, added, removed, self.k)
        if self.kind == "motif":
            return changes.motif_changes(*args)
        if self.kind == "keyword":
            return changes.keyword_changes(*args, self._label(), mining.KEYWORDS)
        if self.kind == "pattern":
            return changes.pattern_changes(*args[:4], self.query)
        if self.keep_triangles:
            triangles, rows = changes.cached_clique4_changes(*args[:4], self.triangles(epoch - 1))
            self._put(triangles.select("vertices", (F.col("status") == "add").alias("alive")), "triangles", epoch)
            return rows
        if self.label_key:
            old, now = self.vertex_labels(epoch - 1), self.vertex_labels(epoch)
            return changes.labelled_clique_changes(*args, old, now)
        rows = changes.clique_changes(*args)
        return rows if self.kind == "clique" else rows.where(F.size(F.array_distinct(F.transform("vertices", self._label()))) == self.k)

    def triangles(self, epoch: int) -> DataFrame:
        """(vertices): the kept triangles as of the end of epoch."""
        rows = self._table("triangles", "vertices array<long>, alive boolean, epoch long").where(F.col("epoch") <= epoch)
        return rows.groupBy("vertices").agg(F.max_by("alive", "epoch").alias("alive")).where("alive").select("vertices")

    def distances(self) -> DataFrame:
        """(v, w, d): the kept distances to keywords, as of the last epoch."""
        rows = self._table("distances", "v long, w int, d int, epoch long")
        last = rows.groupBy(F.col("v").alias("_v")).agg(F.max("epoch").alias("_last"))
        return rows.join(last, (F.col("v") == F.col("_v")) & (F.col("epoch") == F.col("_last"))).where("w is not null").select("v", "w", "d")

    def vertex_labels(self, epoch: int) -> DataFrame:
        """(id, label) of label_key as of the end of epoch; of several updates in an epoch the greatest value counts."""
        rows = self._table("labels", LABELS).where((F.col("epoch") <= epoch) & F.col("dst").isNull() & (F.col("key") == self.label_key))
        return rows.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("epoch", F.col("value").cast("long").alias("label"))).alias("m")).select("id", "m.label")

    def _put_totals(self, rows: DataFrame, epoch: int) -> None:
        self._put(rows.select(F.col("pattern_id").cast("int").alias("pattern_id"), F.col("delta").cast("long").alias("delta"), F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed")), "deltas", epoch)

    def netted(self, updates: DataFrame, before: Graph) -> DataFrame:
        """(src, dst, alive): the edges that the updates really change."""
        kind = F.col("tpe")
        for number, name in enumerate(TYPES):
            kind = F.when(F.col("tpe") == str(number), name).otherwise(kind)
        u = updates.withColumn("kind", kind)
        direct = u.where(F.col("kind").isin("EdgeAdd", "EdgeDel") & (F.col("src") != F.col("dst")))
        direct = direct.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce("ts", F.lit(0)).alias("ts"), (F.col("kind") == "EdgeAdd").alias("alive"))
        gone = u.where("kind = 'VertexDel'").groupBy(F.col("src").alias("v")).agg(F.max(F.coalesce("ts", F.lit(0))).alias("ts"))
        known = before.edges.select("src", "dst").unionByName(direct.where("alive").select("src", "dst")).distinct()
        ends = known.select("src", "dst", F.explode(F.array("src", "dst")).alias("v")).join(gone, "v")
        rows = direct.unionByName(ends.select("src", "dst", "ts", F.lit(False).alias("alive")))
        last = rows.groupBy("src", "dst").agg(F.max(F.struct("ts", F.lit(0).alias("z"))).alias("m"), F.collect_set(F.struct("ts", "alive")).alias("s"))
        ops = last.select("src", "dst", F.array_distinct(F.transform(F.filter("s", lambda x: x["ts"] == F.col("m.ts")), lambda x: x["alive"])).alias("ops")).where("size(ops) = 1")
        was = before.edges.select("src", "dst", F.lit(True).alias("was"))
        return ops.select("src", "dst", F.col("ops")[0].alias("alive")).join(was, ["src", "dst"], "left").where("alive != coalesce(was, false)").drop("was")

    def apply(self, updates: DataFrame, epoch: int) -> None:
        """One batch: its changes, the tables and the output."""
        began = time.perf_counter()
        before = self._kept[1] if self._kept and self._kept[0] == epoch - 1 else self._pinned(epoch - 1)
        self._put(self.netted(updates, before), "log", epoch)
        labels = updates.where(F.col("tpe").isin("VertexLabelMod", "EdgeLabelMod", "4", "5"))
        self._put(labels.select("src", "dst", "key", "value"), "labels", epoch)
        now = self._table("log", LOG).where(F.col("epoch") == epoch)
        added, removed = now.where("alive").select("src", "dst"), now.where("not alive").select("src", "dst")
        after = self._pinned(epoch)
        if self.query and self.query.pupdate:
            self.query.pupdate(added, removed, epoch)
        rows = self._changes(after, before, added, removed, epoch)
        self._put(rows, "changes", epoch)
        if self.hops:
            self._put(changes.distance_changes(after, before, added, removed, self.hops, self._label(), mining.KEYWORDS), "distances", epoch)
        rows = self.spark.read.parquet(f"{self.folder}/changes/epoch={epoch}")
        if self.kind != "motif":
            n = lambda s: F.count_if(F.col("status") == s)
            delta = rows.agg((n("add") - n("del")).alias("delta"), n("add").alias("added"), n("del").alias("removed")).withColumn("pattern_id", F.lit(0))
        else:
            delta = changes.motif_delta(rows).withColumns({"added": F.lit(0).cast("long"), "removed": F.lit(0).cast("long")})
        self._put_totals(delta, epoch)
        if (epoch + 1) % self.compact_every == 0:
            self._put(after.edges.select("src", "dst"), "base", epoch)
        n = rows.agg(F.count(F.lit(1)).alias("n"), (F.count_if("cached") if self.keep_triangles else F.lit(None).cast("long")).alias("hits")).first()
        done = [(time.perf_counter() - began, added.count(), removed.count(), n["n"], n["hits"])]
        self._put(self.spark.createDataFrame(done, BATCH), "batches", epoch)
        if self.query and self.query.output:
            self.query.output(rows)
        if self.output:
            self.output(rows, epoch)

    def batches(self) -> DataFrame:
        """One row an epoch: seconds, the edges added and removed, the changes, and of these cache_hits, those that a kept triangle closed (null unless keep_triangles)."""
        return self._table("batches", f"{BATCH}, epoch long")

    def totals(self) -> DataFrame:
        """(ts, pattern_id, delta, added, removed, total)"""
        rows = self._table("deltas", "pattern_id int, delta long, added long, removed long, epoch long").withColumnRenamed("epoch", "ts")
        return changes.with_totals(rows, by=["pattern_id"])

    def labels(self) -> DataFrame:
        """The last value of each vertex or edge label: src, dst (null for a vertex), key, value."""
        rows = self._table("labels", LABELS)
        return rows.groupBy("src", "dst", "key").agg(F.max_by("value", "epoch").alias("value"))

    def start(self, updates: DataFrame, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        """updates: a stream with UPDATE's columns."""
        writer = updates.writeStream.foreachBatch(lambda df, epoch: self.apply(df, epoch))
        writer = writer.option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def replay_batches(edges: DataFrame, size: int, preload: int = 0, seed: int | None = None) -> DataFrame:
    """edges with batch: 0 for the first preload edges, then from 1 on, size edges each, in the order of (src, dst) or, with a seed, of a hash of it.

    Ranks come from counts of ranges, so that no task orders the whole table.
    """
    key = F.struct("src", "dst") if seed is None else F.struct(F.xxhash64("src", "dst", F.lit(seed)).alias("h"), "src", "dst")
    placed = edges.withColumn("_k", key).repartitionByRange("_k").withColumn("_p", F.spark_partition_id())
    placed = pinned(placed)
    own = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    held = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("m"))  # one row a partition
    before = F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.select("_p", before.alias("_b"))
    rank = F.col("_b") + F.col("_n") - 1
    batch = F.when(rank < preload, 0).otherwise(F.floor((rank - preload) / size) + 1)
    return own.join(F.broadcast(base), "_p").withColumn("batch", batch.cast("long")).drop("_k", "_p", "_n", "_b")
