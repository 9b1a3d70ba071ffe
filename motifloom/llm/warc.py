"""A sharded WARC writer and its reader.

Records are range-sorted by page_id; each task writes its records, one gzip member each, to files of its shard's folder that roll
over at a compressed size. A file is written under a temporary name and, when it is complete, renamed to one that has the attempt in
it, so no attempt of a task touches what another wrote; the manifest, written by Spark's own committer after all tasks, names the
files that count, and what else lies in the shards is removed then.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import partitions

#: A file rolls over when it has so many compressed bytes.
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, about.
SHARD_BYTES = 512 << 20
CHUNK = 16 << 10
MANIFEST = "file string, n_records long, n_bytes long, sha256 string, first_id long, last_id long"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, key)}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


class Roll:
    """Writes members to files <folder>/<shard>/<number>-<attempt>.warc.gz, each complete or not there."""

    def __init__(self, folder: str, shard: str, attempt: str, roll_bytes: int):
        self.fs, self.folder = files(folder)
        self.shard, self.attempt, self.most, self.number, self.out = shard, attempt, roll_bytes, 0, None

    def add(self, data: bytes, page_id: int | None) -> dict | None:
        if self.out is None:
            if not self.number:
                self.fs.create_dir(f"{self.folder}/{self.shard}", recursive=True)
            self.name = f"{self.shard}/{self.number:05d}-{self.attempt}.warc.gz"
            self.out, self.sha, self.n, self.size, self.first = self.fs.open_output_stream(self._temp(), compression=None), hashlib.sha256(), 0, 0, page_id
        self.out.write(data)
        self.sha.update(data)
        self.n, self.size, self.last = self.n + 1, self.size + len(data), page_id
        return self.close() if self.size >= self.most else None

    def _temp(self) -> str:
        shard, _, name = self.name.partition("/")
        return f"{self.folder}/{shard}/.tmp-{name}"

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self._temp(), f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return {"file": self.name, "n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest(), "first_id": self.first, "last_id": self.last}


def shard_name(i: int) -> str:
    return f"shard-{i:06d}"


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, level: int = 3, shards: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) to folder and returns the manifest.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of at least min_revisit_bytes
    the smallest page_id (nulls last) is a response, the others are revisits of it; smaller ones are responses. A null url has no
    WARC-Target-URI. Rows that repeat a page_id are records of their own, in the order of payload hash and url: the first of those
    with one payload can be the response, and its record id is what revisits refer to. shards: as many as payloads have SHARD_BYTES
    (spark.sql.shuffle.partitions at least) if not given. Extra columns are ignored; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    at, inner = files(folder)
    at.create_dir(inner, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    keys = rows.select("page_id", "sha", F.octet_length("html").alias("n_bytes"))
    n = shards or max(partitions(spark), -(-(keys.agg(F.sum("n_bytes")).first()[0] or 0) // SHARD_BYTES))
    keys = keys.where(F.col("n_bytes") >= min_revisit_bytes)
    first = keys.groupBy("sha", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    copies = keys.join(first, ["sha", "n_bytes"]).distinct()
    # a copy's verdict travels as a row of its own, sorted before the page, so that payloads are shuffled once
    none = F.lit(None)
    verdicts = copies.select("page_id", "sha", F.lit(0).alias("kind"), "first_id", none.cast("string").alias("url"), none.cast("string").alias("html"))
    records = rows.select("page_id", "sha", F.lit(1).alias("kind"), none.cast("long").alias("first_id"), "url", "html")
    # the payload's hash in the key divides the rows of a page_id (or of none) that many have
    ordered = verdicts.unionByName(records).repartitionByRange(n, "page_id", "sha").sortWithinPartitions("page_id", "sha", "kind", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        roll = Roll(folder, shard_name(task.partitionId()), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll_bytes)
        of, before, first = object(), 0, None
        for b in batches:
            done = []
            for page_id, sha, kind, first_id, url, html in b[["page_id", "sha", "kind", "first_id", "url", "html"]].itertuples(index=False, name=None):
                page_id = None if pd.isna(page_id) else int(page_id)
                if (page_id, sha) != of:
                    of, before, first = (page_id, sha), 0, None  # before: records with this page_id and payload
                if kind == 0:
                    first = int(first_id)
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                revisit = first is not None and (page_id != first or before > 0)
                own = record_id(f"page:{page_id}:{sha}{f':{before}' if before else ''}")
                before += 1
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
                if not pd.isna(url):
                    headers.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"page:{first}:{sha}")), ("X-Refers-To-Page-ID", str(first))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers.append(("Content-Type", "application/http; msgtype=response"))
                block = http if revisit else http + payload
                if got := roll.add(member([*headers, ("WARC-Block-Digest", f"sha1:{digest_of(block)}")], block, level), page_id):
                    done.append(got)
            if done:
                yield pd.DataFrame(done)
        if got := roll.close():
            yield pd.DataFrame([got])

    manifest = f"{folder}/manifest"
    ordered.mapInPandas(write, MANIFEST).repartition(1 + n // 1000).write.mode("overwrite").parquet(manifest)
    remove_leftovers(spark, folder, n)
    return spark.read.parquet(manifest)


def remove_leftovers(spark: SparkSession, folder: str, shards: int) -> None:
    """Deletes the files of shards that folder's manifest doesn't name: those of attempts that failed or came second."""
    listed = spark.read.parquet(f"{folder}/manifest").groupBy(F.substring_index("file", "/", 1).alias("shard")).agg(F.collect_list("file").alias("files"))
    every = spark.range(shards).select(F.format_string("shard-%06d", "id").alias("shard")).join(listed, "shard", "left")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, inner = files(folder)
        for b in batches:
            gone = 0
            for shard, named in zip(b["shard"].array, b["files"].array, strict=True):
                keep = set() if named is None else set(named)
                for f in at.get_file_info(fs.FileSelector(f"{inner}/{shard}", allow_not_found=True)):
                    if f"{shard}/{f.base_name}" not in keep:
                        at.delete_file(f.path)
                        gone += 1
            yield pd.DataFrame({"gone": [gone]})

    every.mapInPandas(clean, "gone long").agg(F.sum("gone")).collect()


def parse_members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member; an error names what doesn't hold."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a WARC file ends within a record")
            chunk = data[at : at + CHUNK]
            parts.append(z.decompress(chunk))
            at += len(chunk)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if f"sha1:{digest_of(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"the block of {headers['WARC-Record-ID']} doesn't have its digest")
        yield headers, block


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record of the files that folder's manifest names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits and where payloads is False). payload_bytes and payload_digest are of the full payload, also for revisits."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, sha in zip(b["file"].array, b["sha256"].array, strict=True):
                at, inner = files(folder)
                with at.open_input_stream(f"{inner}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} isn't what the manifest has")
                out = []
                for h, block in parse_members(data):
                    body = None if h["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                    if body is not None and (h["WARC-Payload-Digest"] != f"sha1:{digest_of(body)}" or len(body) != int(h["X-Payload-Length"])):
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't have its digest")
                    number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                    out.append((number("X-Page-ID"), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number("X-Refers-To-Page-ID"), body if payloads else None))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.read.parquet(f"{folder}/manifest").select("file", "sha256", "n_bytes")
    there = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).first()
    n = max(1, min(there["n"], max(3 * spark.sparkContext.defaultParallelism, (there["b"] or 0) // ROLL_BYTES)))
    return listed.drop("n_bytes").repartition(n).mapInPandas(read, RECORD)
