"""What the operators of this subpackage share: tables, the shared folder, range buckets and connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="motifloom-"))
    return os.path.dirname(sc.getCheckpointDir())


def own_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is made and run within are removed when it has ended, not when the driver collects garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df, computed once and written as a table in the shared folder; its lineage ends there, and its shuffles' files go."""
    spark, folder = df.sparkSession, own_dir(df.sparkSession, kind)
    with swept(spark):
        df.write.parquet(folder)
    return spark.read.parquet(folder)


_libc = ctypes.CDLL(None)


def trim() -> None:
    """At a Python task's end: memory that is free goes back to the system. Workers are used again, and would hold what their largest task took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):  # glibc
        _libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


#: So many ranges at most have their split points from quantiles; more divide these evenly.
COARSE = 1 << 15
#: Quantiles are of about so many keys at most.
SAMPLED = 4_000_000


def range_buckets(df: DataFrame, key: str, out: str, n: int) -> DataFrame:
    """df with a column out (int): the range of key that the row lies in, ascending, about n ranges of equal weight.

    Equal keys share a bucket; null keys form the last one. Up to COARSE ranges end at quantiles of the keys (of a sample by hash,
    where there are over SAMPLED), so that they hold for any distribution of ids; if n is greater each is divided evenly between its ends.
    Only the weight of the ranges depends on the sample. df must not have columns out__key, out__b, out__lo, out__hi.
    """
    coarse = max(2, min(n, COARSE))
    fine = -(-n // coarse)
    k = F.col(key).cast("double")
    total = df.agg(F.count(key)).first()[0]
    keys = df.select(k.alias("_k"), F.xxhash64(key, F.lit(7)).alias("_h")).where("_k is not null")
    if total > SAMPLED:
        keys = keys.where(F.pmod("_h", F.lit(1 << 30)) < int(SAMPLED / total * (1 << 30)))
    got = keys.agg(F.percentile_approx("_k", [i / coarse for i in range(1, coarse)], 10 * max(1_000, coarse)).alias("q"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).first()
    splits = sorted(set(got["q"] or []))
    if not splits:
        return df.withColumn(out, F.lit(0))
    bounds = [float("-inf"), *splits, float("inf")]
    put = Bucketizer(splits=bounds, inputCol=f"{out}__key", outputCol=f"{out}__b", handleInvalid="keep")
    placed = put.transform(df.withColumn(f"{out}__key", k)).withColumn(f"{out}__b", F.col(f"{out}__b").cast("int"))
    at = F.col(f"{out}__b")
    if fine > 1:
        ends = [min(got["lo"], splits[0]), *splits, max(got["hi"], splits[-1])]
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False))]  # COARSE rows at most
        ends = F.broadcast(df.sparkSession.createDataFrame(rows, f"{out}__r int, {out}__lo double, {out}__hi double"))
        placed = placed.join(ends, at == F.col(f"{out}__r"), "left").drop(f"{out}__r")
        lo, hi = F.col(f"{out}__lo"), F.col(f"{out}__hi")
        part = F.when(hi > lo, F.floor((F.col(f"{out}__key") - lo) / (hi - lo) * fine)).otherwise(F.lit(0))
        at = at * fine + F.greatest(F.lit(0), F.least(part, F.lit(fine - 1)))
    return placed.withColumn(out, F.coalesce(at.cast("int"), F.lit(len(bounds) * fine))).drop(f"{out}__key", f"{out}__b", f"{out}__lo", f"{out}__hi")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that it can reach.

    Alternating large-star and small-star rounds, each two joins against a table with one row a node, so
    that a hub's rows can be split. Ends when a round changes nothing; each round is cut off by a checkpoint.
    Null ends and loops are ignored. No edges: no rows.
    """
    a, b = F.col(u), F.col(v)
    e = pinned(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first())
    before, now = None, mark(e)
    while now[0] and before != now:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pinned(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        before, now = now, mark(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
