"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers that are broadcast at most.
BROADCAST_ROWS = 500_000


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir (where that is unset and all run on one machine, as in tests, a folder of our own)."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="motifloom-"))
    return named or os.path.dirname(sc.getCheckpointDir())


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    """A pinned df, to be broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is made and run within are removed when it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
