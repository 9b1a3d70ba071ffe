"""The graph: a DataFrame with each undirected edge once, and views of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst) with src < dst, each once; loops and pairs with a null end go."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), (a != b).alias("_two")).where("_two").drop("_two").distinct()


#: Where labels are put above ids.
ID_SPAN = 1 << 48
NO_LABEL = -1


def label_of(v: Column) -> Column:
    return F.shiftright(v, 48)


def id_of(v: Column) -> Column:
    return v - label_of(v) * ID_SPAN


@dataclass
class Graph:
    """edges: src < dst, each once, with add_ts and del_ts (null: alive) where the graph has a history. labels: (id, label), else derived from ids."""

    edges: DataFrame
    labels: DataFrame | None = None

    @classmethod
    def from_pairs(cls, pairs: DataFrame, src: str = "src", dst: str = "dst", labels: DataFrame | None = None) -> Graph:
        return cls(clean(pairs, src, dst), labels)

    @classmethod
    def from_history(cls, edges: DataFrame) -> Graph:
        """edges (src, dst, add_ts, del_ts): an edge's stays must not overlap."""
        return cls(edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "add_ts", "del_ts"))

    def snapshot(self, t: int | Column) -> Graph:
        """The graph as of epoch t."""
        t = F.lit(t)
        alive = self.edges.where((F.col("add_ts") <= t) & (F.col("del_ts").isNull() | (F.col("del_ts") > t)))
        return Graph(alive.select("src", "dst", "add_ts", "del_ts"), self.labels)

    def forward(self, ts: bool = False) -> DataFrame:
        """(v, u) with u > v; with ts also the epoch add_ts that added the edge."""
        return self.edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), *(["add_ts"] if ts else []))

    def backward(self, ts: bool = False) -> DataFrame:
        return self.edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), *(["add_ts"] if ts else []))

    def symmetric(self, ts: bool = False) -> DataFrame:
        """(v, u) in both directions, by one pass over the edges; with ts also add_ts."""
        both = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
        more = ["add_ts"] if ts else []
        return self.edges.select(F.explode(both).alias("e"), *more).select("e.v", "e.u", *more)

    def edge_ts(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """The rows of pairs whose ends are adjacent, with add_ts."""
        e = self.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "add_ts")
        return pairs.join(e, (F.least(a, b) == F.col("_s")) & (F.greatest(a, b) == F.col("_d"))).drop("_s", "_d")

    def labelled(self) -> Graph:
        """The graph of the same edges between (label, id) in one number, label * 2^48 + id, from labels (id, label); vertices without one get -1.
        Ids must be from 0 to 2^48 - 1, labels below 2^14. So label_of() and id_of() are Columns and queries by label need no join."""
        known = self.labels.select(F.col("id").alias("_id"), F.col("label").cast("long").alias("_label"))
        e = self.edges.select("src", "dst")
        for end in ("src", "dst"):
            e = e.join(known, F.col(end) == F.col("_id"), "left").withColumn(end, F.col(end) + F.coalesce("_label", F.lit(NO_LABEL)) * ID_SPAN).drop("_id", "_label")
        return Graph.from_pairs(e)

    def degree(self) -> DataFrame:
        """(v, degree): combined before the shuffle."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))

    def adjacency(self) -> DataFrame:
        """(v, nb): each vertex's neighbours in order. A row is as long as the vertex's degree; see oriented() for rows that stay short."""
        return self.symmetric().groupBy("v").agg(F.sort_array(F.collect_list("u")).alias("nb"))

    def oriented(self) -> DataFrame:
        """(v, out): the neighbours that follow v in the order of (degree, id). No row is longer than the square root of twice the edges, whatever the hubs."""
        d = self.degree()
        e = self.edges.select("src", "dst").join(d.select(F.col("v").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("v").alias("dst"), F.col("degree").alias("dd")), "dst")
        first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
        e = e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("u"))
        return e.groupBy("v").agg(F.sort_array(F.collect_list("u")).alias("out"))

    def has_edges(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """The rows of pairs whose ends are adjacent."""
        e = self.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        return pairs.join(e, (F.least(a, b) == F.col("_s")) & (F.greatest(a, b) == F.col("_d")), "left_semi")

    def seeds(self, least_degree: int) -> DataFrame:
        """The edges both of whose ends have at least this degree."""
        d = self.degree().where(F.col("degree") >= least_degree).select("v")
        ends = self.edges.join(d.withColumnRenamed("v", "src"), "src", "left_semi")
        return ends.join(d.withColumnRenamed("v", "dst"), "dst", "left_semi").select(*self.edges.columns)

    def core(self, k: int) -> Graph:
        """The k-core: seeds(k) until nothing goes. Each round is cut off by a checkpoint."""
        from motifloom.plans.cut import pinned

        g, before = self, -1
        while (now := (g := Graph(pinned(g.edges), self.labels)).edges.count()) != before:
            before, g = now, Graph(g.seeds(k), self.labels)
        return g

