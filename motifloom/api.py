"""One object for a program that feeds a graph and gets matches back: files, an algorithm, batches of updates, a callback."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from motifloom.graph import Graph
from motifloom.operators import mining
from motifloom.sources import files
from motifloom.streaming.runner import TYPES, UPDATE, GraphStream

#: Numbers of the built-in algorithms.
ALGORITHMS = {0: "clique", 1: "motif", 2: "color", 3: "keyword"}


class GraphMiner:
    """Static mining of a graph, or changes by batch. A batch is sent by batch_new, or gathered by the single updates and sent by flush."""

    def __init__(self, spark: SparkSession, folder: str | None = None, k: int = 3, algorithm: str | int | mining.PatternQuery = "clique"):
        self.spark, self.folder, self.k = spark, folder, k
        self.graph: Graph | None = None
        self.callback: Callable[[DataFrame, int], None] | None = None
        self.pending: list[tuple] = []
        self.epoch, self.stream = 0, None
        self.set_algorithm(algorithm)

    def set_graph_input_files(self, path: str, kind: str = "binary") -> None:
        """kind: binary, text or parquet."""
        self.graph = {"binary": files.binary_graph, "text": files.text_graph, "parquet": files.parquet_graph}[kind](self.spark, path)

    def set_algorithm(self, algorithm: str | int | mining.PatternQuery) -> None:
        self.algorithm = ALGORITHMS.get(algorithm, algorithm) if isinstance(algorithm, int) else algorithm
        if isinstance(self.algorithm, mining.PatternQuery):
            self.k = self.algorithm.k

    def set_output_callback(self, callback: Callable[[DataFrame, int], None]) -> None:
        self.callback = callback

    def unset_output_callback(self) -> None:
        self.callback = None

    def mine(self) -> DataFrame:
        """The static answer: found for cliques and colours, pattern_id and cnt for motifs, rows otherwise."""
        if isinstance(self.algorithm, mining.PatternQuery):
            return self.algorithm.run(self.graph)
        run = {"clique": mining.kclique_count, "motif": mining.motif_census, "color": mining.color_clique_count, "keyword": mining.keyword_sets}[self.algorithm]
        return run(self.graph, self.k)

    def start(self, **options) -> None:
        """Begins an evolving graph in folder, with the input files' graph (or none) as its first state. options: further ones of GraphStream."""
        own = self.algorithm if isinstance(self.algorithm, mining.PatternQuery) else None
        self.stream = GraphStream(self.spark, self.folder, self.k, "pattern" if own else self.algorithm, lambda df, t: self.callback(df, t) if self.callback else None, query=own, **options)
        self.preload_chunk(self.graph.edges if self.graph else self.spark.createDataFrame([], "src long, dst long"))

    def preload_chunk(self, pairs: DataFrame) -> None:
        self.stream.preload(pairs)

    def batch_new(self, updates: DataFrame | Iterable[tuple]) -> int:
        """Applies updates (a table like UPDATE, or rows of it) as one epoch and returns its number."""
        df = updates if isinstance(updates, DataFrame) else self.spark.createDataFrame(list(updates), UPDATE)
        self.stream.apply(df, self.epoch)
        self.epoch += 1
        return self.epoch - 1

    def _update(self, kind: int, src: int, dst: int | None = None, key: str | None = None, value: str | None = None) -> None:
        self.pending.append((TYPES[kind], src, dst, len(self.pending), key, value))

    def vertex_new(self, v: int) -> None:
        self._update(0, v)

    def vertex_del(self, v: int) -> None:
        self._update(1, v)

    def edge_new(self, src: int, dst: int) -> None:
        self._update(2, src, dst)

    def edge_del(self, src: int, dst: int) -> None:
        self._update(3, src, dst)

    def vertex_label_is(self, v: int, key: str, value: str) -> None:
        self._update(4, v, None, key, value)

    def edge_label_is(self, src: int, dst: int, key: str, value: str) -> None:
        self._update(5, src, dst, key, value)

    def flush(self) -> int:
        """Sends the updates gathered so far as one batch; later ones outweigh earlier ones."""
        rows, self.pending = self.pending, []
        return self.batch_new(rows)

    def totals(self) -> DataFrame:
        return self.stream.totals()

    def batches(self) -> DataFrame:
        """Seconds and counts of each batch."""
        return self.stream.batches()

    def stop(self) -> None:
        self.stream, self.pending, self.epoch = None, [], 0
