"""Edges from files: Parquet, text, and binary edge lists with their offsets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motifloom.graph import Graph, clean

#: Bytes of a binary file that one task reads.
SPLIT = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Slice(InputPartition):
    """Bytes start to end of a file, the first of which has number first among all records."""

    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


class RecordReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list[Slice]:
        at, inner = _open(self.path)
        info = at.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in at.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-")), key=lambda f: f.path)
        out, first = [], 0
        for f in files:
            if f.size % 8:
                raise ValueError(f"{f.path} has {f.size} bytes, no multiple of 8")
            out += [Slice(f.path, i, min(i + self.split, f.size), first + i // 8) for i in range(0, f.size, self.split)]
            first += f.size // 8
        return out or [Slice(inner, 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if part.start == part.end:
            return
        at, _ = _open(self.path)
        with at.open_input_file(part.path) as f:
            for start in range(part.start, part.end, 8 << 20):
                data = f.read_at(min(8 << 20, part.end - start), start)
                first = part.first + (start - part.start) // 8
                pos = pa.array(np.arange(first, first + len(data) // 8, dtype=np.int64))
                if self.kind == "edges":
                    pair = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pos, pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["pos", "src", "dst"])
                else:
                    yield pa.RecordBatch.from_arrays([pos, pa.array(np.frombuffer(data, "<u8").astype(np.int64))], names=["v", "off"])


class BinaryGraphSource(DataSource):
    """format("binary_graph"): little-endian records of 8 bytes in a file, or in a folder's files part-* in the order of their names; kind edges (u32 src, u32 dst: pos, src, dst) or offsets (u64: v, off)."""

    @classmethod
    def name(cls) -> str:
        return "binary_graph"

    def schema(self) -> str:
        return "pos long, src long, dst long" if self.options.get("kind", "edges") == "edges" else "v long, off long"

    def reader(self, schema) -> RecordReader:
        split = max(8, int(self.options.get("split", SPLIT)) // 8 * 8)
        return RecordReader(self.options["path"], self.options.get("kind", "edges"), split)


def binary_edges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(pos, src, dst) of a binary edge list, read in slices."""
    spark.dataSource.register(BinaryGraphSource)
    return spark.read.format("binary_graph").option("kind", "edges").option("split", split).option("path", path).load()


def binary_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(v, off): the position of each vertex's first edge."""
    spark.dataSource.register(BinaryGraphSource)
    return spark.read.format("binary_graph").option("kind", "offsets").option("path", path).load()


def write_binary(g: Graph, folder: str) -> None:
    """Writes g's edges in both directions, in order, to folder/edges, and the position of each vertex's first one, for all ids from 0 to the largest, to
    folder/offsets, each as files part-*. A task writes a file of its own attempt under a temporary name and renames it to its part's: the bytes are the same whichever attempt is last.
    Ids must be from 0 to 2^32 - 1."""
    from motifloom.plans.cut import pinned

    spark = g.edges.sparkSession
    both = pinned(g.symmetric().repartitionByRange("v", "u").sortWithinPartitions("v", "u").withColumn("p", F.spark_partition_id()))
    _write_parts(both.repartition("p").sortWithinPartitions("p", "v", "u"), f"{folder}/edges", ["v", "u"], "<u4")
    most = both.agg(F.max("v")).first()[0]
    n = both.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(0, 0 if most is None else most + 1).withColumnRenamed("id", "v").join(n, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"), F.expr("cast(v div 65536 as int)").alias("p"))
    held = every.groupBy("p").agg(F.sum("n").alias("m"))  # one row for 65536 ids
    before = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("p", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("b"))
    own = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    off = every.withColumn("o", F.coalesce(F.sum("n").over(own), F.lit(0))).join(base, "p").select("p", "v", (F.col("o") + F.col("b")).alias("off"))
    _write_parts(off.repartition("p").sortWithinPartitions("p", "v"), f"{folder}/offsets", ["off"], "<u8")


def _write_parts(rows: DataFrame, folder: str, columns: list[str], kind: str) -> None:
    """Rows, in order by p, to one file for each p."""
    at, inner = _open(folder)
    at.create_dir(inner, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, inner = _open(folder)
        out, of, names = None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                at.move(*names)

        for b in batches:
            for p, part in b.groupby("p", sort=True):
                if p != of:
                    close()
                    of, names = p, [f"{inner}/.tmp-{p:08d}-{uuid.uuid4().hex}", f"{inner}/part-{p:08d}"]
                    out = at.open_output_stream(names[0], compression=None)
                out.write(part[columns].to_numpy(kind).tobytes())
        close()
        yield pd.DataFrame({"done": [True]})

    rows.mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()


def misplaced(edges: DataFrame, offsets: DataFrame) -> DataFrame:
    """What doesn't hold between an edge list and its offsets: vertices (v, off, first, degree, kept) whose edges don't begin at their offset or aren't together."""
    own = edges.groupBy(F.col("src").alias("v")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("degree"))
    return offsets.join(own, "v", "full").where("degree is not null and (off is null or first != off or last - first + 1 != degree)")


def binary_graph(spark: SparkSession, path: str) -> Graph:
    return Graph.from_pairs(binary_edges(spark, path))


def parquet_graph(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> Graph:
    return Graph.from_pairs(spark.read.parquet(path), src, dst)


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines with two numbers between white space; other lines go."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+\s*$")).select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def text_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(clean(text_pairs(spark, path)))


def metadata_vertices(spark: SparkSession, path: str) -> int | None:
    """The number after vertices= in a metadata file."""
    row = spark.read.text(path).select(F.regexp_extract("value", r"^\s*vertices\s*=\s*(\d+)", 1).alias("n")).where("n != ''").first()
    return int(row["n"]) if row else None
