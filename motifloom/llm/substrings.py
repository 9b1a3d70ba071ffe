"""Substring dedup: repeated k-word passages as compacted paths of a de Bruijn graph.

A window of k words is an edge between its first and its last k-1 words, the nodes. Documents lie in batches, ranges of
doc_id. Each batch sends its distinct edges, with the place where each starts first, to the edge's bucket; the bucket finds
the first batch and place of every edge and tells the batches. The graph is that of the edges that start in two documents or more:

1. the batch of an edge's first place writes it down, runs of such edges as a chain of nodes with its source coordinates;
2. in- and out-degrees of the nodes are counted; a chain is cut where an inner node has another edge in or out;
3. what is left is joined end to start where a node has one edge in and one out, and pointer jumping (joins that double
   their reach) gives every piece its path, a maximal nonbranching one, and its offset there;
4. a later document's windows whose first places follow one another are a span. The spans' distinct coordinates are looked up in the source's
   chains, and the nodes there compared with the span's own (by a 128-bit digest of their hashes, which are independent of the edges');
5. a span that doesn't agree (its edges' 64-bit hashes collide with others) is looked at window by window: all windows of
   these hashes are compared by 192 bits.

So no group grows with the number of copies: a batch sends an edge once, and equal coordinates are one question.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.common import connected_components, partitions, pinned, range_buckets, written

#: Bytes of text in a batch, and edges in a bucket, about.
BATCH_BYTES = 4 << 20
BUCKET_EDGES = 1 << 20
MIN_BUCKETS = 256
#: Rows of two or three numbers that are broadcast at most; hashes that one second look takes.
BROADCAST_ROWS = 500_000
#: Distinct spans that one task looks up in a batch's chains, about.
ASKS = 1 << 12
LAST = np.iinfo(np.int64).max
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class Stream:
    """The words of a batch's documents, in the order of doc_id (nulls last) and text, one space between them."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        ids = table[doc_id].cast(pa.int64()).combine_chunks()
        key = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table[text].to_pylist()]
        # Python's sort is stable, and compares texts only where ids tie
        self.rows = np.array(sorted(range(len(key)), key=lambda i: (key[i], texts[i])), np.int64)
        self.ids = key[self.rows]
        texts = [texts[i] for i in self.rows]
        size = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = np.zeros(len(raw), bool)
        if len(raw):
            first[1:] = gap[1:] & ~gap[:-1]
        keep = ~gap | first
        where = np.cumsum(keep)  # bytes kept up to and with each
        self.buf = np.where(gap, np.uint8(32), raw)[keep]
        ends = np.flatnonzero(self.buf == 32)
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1)) if len(ends) else np.empty(0, np.int64)
        self.start, self.end = starts, ends
        doc_ends = where[np.cumsum(size + 1) - 1] if len(size) else np.empty(0, np.int64)
        self.doc = np.searchsorted(doc_ends, ends, side="left") if len(ends) else np.empty(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(size)))  # word of each document

    def words(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        padded = np.concatenate((self.buf, np.zeros(8, np.uint8)))
        lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = _mix((size.astype(np.uint64) + np.uint64(seed)) * _K1)
        at, lane = np.arange(len(size)), 0
        while len(at):
            rest = np.minimum(size[at] - 8 * lane, 8)
            v = lanes[self.start[at] + 8 * lane] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest.astype(np.uint64)))
            h[at] = _mix((h[at] ^ v) * _K1)
            lane += 1
            at = at[size[at] > 8 * lane]
        return h

    def windows(self, k: int, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The first word's index and a 64-bit hash of each window of k words in one document; only its upper hash_bits are kept."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        w, h = self.words(), np.zeros(n, np.uint64)
        for j in range(k):
            h *= _K1
            h += w[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, _mix(h[at]) >> np.uint64(64 - hash_bits) << np.uint64(64 - hash_bits)

    def nodes(self, k: int) -> np.ndarray:
        """A 64-bit hash of the k-1 words from each word on, from other word hashes than those of windows."""
        n = max(0, len(self.start) - k + 2)
        h = np.zeros(n, np.uint64)
        if k > 1 and n:
            w = self.words(1 << 40)
            for j in range(k - 1):
                h *= _K3
                h += w[j : j + n]
        return _mix(h + _K2)


class Edges:
    """The distinct edges of a stream, by bucket and then by their first place; which of them each window is."""

    def __init__(self, stream: Stream, k: int, bits: int, hash_bits: int):
        self.at, h = stream.windows(k, hash_bits)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        firsts = order[new]
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        bucket = (h[firsts] >> np.uint64(64 - bits)).astype(np.int64)
        by = np.lexsort((firsts, bucket))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.of = rank[of]  # of each window
        self.hash, self.place, self.bucket = h[firsts[by]], self.at[firsts[by]], bucket[by]
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))

    def parts(self) -> Iterator[tuple[int, slice]]:
        for i, j in zip(self.cuts, [*self.cuts[1:], len(self.bucket)][: len(self.cuts)], strict=True):
            yield int(self.bucket[i]), slice(int(i), int(j))


def _pack(x: np.ndarray) -> bytes:
    """Small non-negative numbers: the low bytes as they are, the upper ones compressed."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return planes[:, 0].tobytes() + zlib.compress(np.ascontiguousarray(planes[:, 1:].T).tobytes(), 1)


def _unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.empty((n, 4), np.uint8)
    planes[:, 0] = np.frombuffer(b, np.uint8, n)
    planes[:, 1:] = np.frombuffer(zlib.decompress(b[n:]), np.uint8).reshape(3, n).T
    return planes.view("<u4").ravel().astype(np.int64)


SENT = "bucket int, batch int, n int, hashes binary, places binary"
TOLD = "batch int, bucket int, n int, later binary, batches binary, places binary, sources binary"
#: A chain of the batch's own edges from place on (nodes: n + 1 hashes), or a span of n windows from place on whose first places are src_batch, src_place and on.
FOUND = "batch int, place int, n int, doc_id long, word int, nodes array<long>, src_batch int, src_place int, digest binary"
PART = "array<struct<path:long,at:int,start:int,n:int>>"
GRANTED = f"src_batch int, src_place int, n int, digest binary, src_doc_id long, src_word int, parts {PART}"
SPAN = ["src_batch", "src_place", "n", "digest"]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds[PART] = pa.list_(pa.struct([("path", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]))
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _digest(nodes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(nodes.tobytes())


class _Batches:
    """The documents of a table in batches, and the steps over them."""

    def __init__(self, docs: DataFrame, k: int, batch_bytes: int, bucket_edges: int, doc_id: str, text: str, hash_bits: int):
        self.spark, self.k, self.doc_id, self.text, self.hash_bits = docs.sparkSession, k, doc_id, text, hash_bits
        size = F.octet_length(text)
        sums = docs.agg(F.sum(size).alias("all"), F.sum(F.when(F.col(doc_id).isNull(), size)).alias("none")).first()
        n_bytes = sums["all"] or 0
        n_batches = max(partitions(self.spark), -(-n_bytes // batch_bytes))
        self.bits = max(int(MIN_BUCKETS).bit_length() - 1, (n_bytes // 6 // bucket_edges).bit_length())
        placed = range_buckets(docs, doc_id, "mf_batch", n_batches)
        # rows without an id don't count as earlier for one another, so they can be divided; their batches are the last ones
        self.none_from = 1 << 30
        many = 1 + (sums["none"] or 0) // batch_bytes
        none = (F.lit(self.none_from) + F.pmod(F.xxhash64(text), F.lit(many))).cast("int")
        self.placed = placed.withColumn("mf_batch", F.when(F.col(doc_id).isNull(), none).otherwise(F.col("mf_batch")))

    def found(self) -> DataFrame:
        """Rows FOUND: chains of repeated edges by their first place, and spans of later documents."""
        k, bits, hash_bits, doc_id, text, none_from = self.k, self.bits, self.hash_bits, self.doc_id, self.text, self.none_from
        sent_as, told_as, found_as = _arrow(SENT), _arrow(TOLD), _arrow(FOUND)
        mask = np.uint64((1 << 56) - 1)

        def send(key: tuple, b: pa.Table) -> pa.Table:
            e, out = Edges(Stream(b, doc_id, text), k, bits, hash_bits), []
            for bucket, part in e.parts():
                seven = e.hash[part].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()  # the eighth is in the bucket
                out.append({"bucket": bucket, "batch": key[0].as_py(), "n": part.stop - part.start, "hashes": seven, "places": _pack(np.diff(e.place[part], prepend=0))})
            return pa.Table.from_pylist(out, sent_as)

        def tell(key: tuple, b: pa.Table) -> pa.Table:
            b = b.sort_by("batch")
            count, batch = b["n"].to_numpy(), b["batch"].to_numpy()
            h = np.zeros((count.sum(), 8), np.uint8)
            h[:, :7] = np.frombuffer(b"".join(b["hashes"].to_pylist()), np.uint8).reshape(-1, 7)
            h = h.view("<u8").ravel() & mask
            place = np.concatenate([np.cumsum(_unpack(p, n)) for p, n in zip(b["places"].to_pylist(), count.tolist(), strict=True)])
            order = np.argsort(h, kind="stable")  # of equal edges the earliest batch is first
            new = np.ones(len(h), bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            source = np.empty(len(h), np.int64)
            source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            owner, out, at = np.repeat(batch, count), [], 0
            told = (owner[source] != owner) & (owner[source] < none_from)
            is_source = np.zeros(len(h), bool)
            is_source[source[told]] = True
            for x, n in zip(batch.tolist(), count.tolist(), strict=True):
                later, first = told[at : at + n], is_source[at : at + n]
                if later.any() or first.any():
                    src = source[at : at + n][later]
                    packed = [zlib.compress(v.tobytes(), 1) for v in (np.packbits(later), owner[src].astype("<i4"), place[src].astype("<i4"), np.packbits(first))]
                    out.append({"batch": x, "bucket": key[0].as_py(), "n": n, **dict(zip(("later", "batches", "places", "sources"), packed, strict=True))})
                at += n
            return pa.Table.from_pylist(out, told_as)

        def compact(key: tuple, b: pa.Table, told: pa.Table) -> pa.Table:
            own, s = key[0].as_py(), Stream(b, doc_id, text)
            e, nodes = Edges(s, k, bits, hash_bits), s.nodes(k)
            src_batch, src_place, shared = np.full(len(e.place), own, np.int64), e.place.copy(), np.zeros(len(e.place), bool)
            parts, read = dict(e.parts()), lambda v, kind: np.frombuffer(zlib.decompress(v), kind)
            for r in told.to_pylist():
                part = parts[r["bucket"]]
                later = part.start + np.flatnonzero(np.unpackbits(read(r["later"], np.uint8), count=r["n"]))
                src_batch[later], src_place[later] = read(r["batches"], "<i4"), read(r["places"], "<i4")
                shared[part] |= np.unpackbits(read(r["sources"], np.uint8), count=r["n"]).astype(bool)
            at, batch, place = e.at, src_batch[e.of], src_place[e.of]
            here = batch == own
            first_doc = s.doc[np.where(here, place, 0)] if len(s.doc) else place
            repeated = ~here | (s.ids[first_doc] < s.ids[s.doc[at]]) if len(at) else np.empty(0, bool)
            shared[e.of[repeated & here]] = True
            # chains: this batch's own edges, in the order of their places
            mine = np.sort(e.place[shared])
            of = lambda breaks, n: (np.flatnonzero(breaks), np.diff([*np.flatnonzero(breaks), n]))
            breaks = np.ones(len(mine), bool)
            breaks[1:] = (np.diff(mine) != 1) | (s.doc[mine[1:]] != s.doc[mine[:-1]])
            heads, n_chain = of(breaks, len(mine))
            heads = mine[heads]
            ranges = [np.arange(x, x + m + 1) for x, m in zip(heads.tolist(), n_chain.tolist(), strict=True)]
            # spans: windows in a row whose first places are in a row too
            i = np.flatnonzero(repeated)
            at, batch, place = at[i], batch[i], place[i]
            breaks = np.ones(len(at), bool)
            if k > 1:  # the places of single words are in a row also where a document ends
                breaks[1:] = (np.diff(at) != 1) | (s.doc[at[1:]] != s.doc[at[:-1]]) | (batch[1:] != batch[:-1]) | (np.diff(place) != 1)
            lead, n_span = of(breaks, len(at))
            start = at[lead]
            digests = [_digest(nodes[x : x + m + 1]) for x, m in zip(start.tolist(), n_span.tolist(), strict=True)]
            both, nc, ns = np.concatenate((heads, start)).astype(np.int64), len(heads), len(start)
            doc = s.doc[both] if len(both) else both
            values = pa.array(nodes.view(np.int64)[np.concatenate(ranges)] if ranges else [], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for r in ranges)]), pa.int32()), values)
            ids = s.ids[doc] if len(doc) else doc
            return pa.Table.from_arrays([
                pa.array(np.full(nc + ns, own), pa.int32()), pa.array(both, pa.int32()), pa.array(np.concatenate((n_chain, n_span)), pa.int32()),
                pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(both - (s.first[doc] if len(doc) else 0), pa.int32()),
                pa.concat_arrays([lists, pa.nulls(ns, pa.list_(pa.int64()))]),
                pa.concat_arrays([pa.nulls(nc, pa.int32()), pa.array(batch[lead], pa.int32())]), pa.concat_arrays([pa.nulls(nc, pa.int32()), pa.array(place[lead], pa.int32())]),
                pa.concat_arrays([pa.nulls(nc, pa.binary()), pa.array(digests, pa.binary())]),
            ], schema=found_as)

        by_batch = self.placed.select("mf_batch", doc_id, text).groupBy("mf_batch")
        told = by_batch.applyInArrow(send, SENT).groupBy("bucket").applyInArrow(tell, TOLD)
        return by_batch.cogroup(told.groupBy("batch")).applyInArrow(compact, FOUND)

    def second_look(self, denied: DataFrame) -> DataFrame:
        """(batch, place, n = 1) of the windows of denied spans (batch, place, n) that do start in a document with a smaller id, exactly.

        The denied windows' hashes are taken BROADCAST_ROWS at a time; all windows that have one are compared by hash and nodes."""
        k, hash_bits, doc_id, text = self.k, self.hash_bits, self.doc_id, self.text

        def hashes(key: tuple, b: pa.Table, spans: pa.Table) -> pa.Table:
            at, h = Stream(b, doc_id, text).windows(k, hash_bits)
            depth = np.zeros((at[-1] if len(at) else 0) + 2, np.int64)
            np.add.at(depth, spans["place"].to_numpy(), 1)
            np.add.at(depth, spans["place"].to_numpy() + spans["n"].to_numpy(), -1)
            return pa.table({"h": pa.array(np.unique(h[np.cumsum(depth)[at] > 0]).view(np.int64), pa.int64())})

        by_batch = self.placed.select("mf_batch", doc_id, text).groupBy("mf_batch")
        some = written(by_batch.cogroup(denied.groupBy("batch")).applyInArrow(hashes, "h long").distinct(), "hashes")
        chunks = -(-some.count() // (BROADCAST_ROWS // 2))
        out = None
        for chunk in range(chunks):
            mine = np.sort(np.array([r["h"] for r in some.where(F.pmod(F.xxhash64("h"), F.lit(chunks)) == chunk).collect()], np.int64)).view(np.uint64)
            known = self.spark.sparkContext.broadcast(np.sort(mine))

            def windows(key: tuple, b: pa.Table) -> pa.Table:
                s = Stream(b, doc_id, text)
                at, h = s.windows(k, hash_bits)
                i = np.searchsorted(known.value, h)  # noqa: B023
                hit = known.value[np.minimum(i, len(known.value) - 1)] == h  # noqa: B023
                at, h, nodes = at[hit], h[hit], s.nodes(k).view(np.int64)
                return pa.table({"batch": pa.array(np.full(len(at), key[0].as_py()), pa.int32()), "place": pa.array(at, pa.int32()), "id": pa.array(s.ids[s.doc[at]] if len(at) else at, pa.int64()),
                                 "h": pa.array(h.view(np.int64), pa.int64()), "l": pa.array(nodes[at], pa.int64()), "r": pa.array(nodes[at + 1], pa.int64())})

            seen = written(by_batch.applyInArrow(windows, "batch int, place int, id long, h long, l long, r long"), "windows")
            first = seen.groupBy("h", "l", "r").agg(F.min("id").alias("first"))
            later = seen.join(first, ["h", "l", "r"]).where("first < id").select("batch", "place", F.lit(1).alias("n"))
            out = later if out is None else out.unionByName(later)
        return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def compacted_paths(chains: DataFrame) -> DataFrame:
    """(batch, place, start, n, path, at) of chains (batch, place, n, nodes), each edge of the graph in one of them: the n edges of a chain from edge start on are
    those from edge at on of a path, a maximal nonbranching one. A path is named by its first piece; a cycle starts at its least one."""
    node = chains.select("batch", "place", "n", F.posexplode("nodes").alias("i", "v"))
    degrees = node.groupBy("v").agg(F.count_if(F.col("i") < F.col("n")).alias("outs"), F.count_if(F.col("i") > 0).alias("ins"))
    branching = written(degrees.where("outs > 1 or ins > 1").select("v"), "branching")
    near = _small(branching)
    cuts = node.where("i > 0 and i < n").join(near, "v").groupBy("batch", "place").agg(F.sort_array(F.collect_list("i")).alias("cuts"))
    whole = chains.join(cuts, ["batch", "place"], "left").withColumn("ends", F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("n")))
    piece = F.transform("ends", lambda end, j: F.struct(F.coalesce(F.get("ends", j - 1), F.lit(0)).alias("start"), end.alias("end")))
    pieces = whole.select("batch", "place", "nodes", F.explode(piece).alias("p"))
    # batch and place of the piece's first edge in one number
    number = F.shiftleft(F.col("batch").cast("long"), 32) + F.col("place") + F.col("p.start")
    pieces = pieces.select(number.alias("piece"), "batch", "place", "p.start", (F.col("p.end") - F.col("p.start")).alias("n"), F.col("nodes")[F.col("p.start")].alias("first"), F.col("nodes")[F.col("p.end")].alias("last"))
    pieces = written(pieces, "pieces")
    # a node without a branch has one edge in and one out at most, so a piece has one successor at most
    ends = pieces.select(F.col("piece").alias("before"), F.col("n").alias("length"), F.col("last").alias("v")).join(near, "v", "left_anti")
    links = pinned(ends.join(pieces.select("piece", F.col("first").alias("v")), "v").where("before != piece").select("piece", "before", "length"))
    at = jumped(links)
    return pieces.join(at, "piece", "left").select("batch", "place", "start", "n", F.coalesce("path", "piece").alias("path"), F.coalesce("at", F.lit(0)).cast("int").alias("at"))


def jumped(links: DataFrame) -> DataFrame:
    """(piece, path, at) of links (piece, before, length of before), at most one to and from each piece: the first piece of the row that piece is in,
    and the length before it. Pointers double their reach by each of two joins a round; where no more arrive, what is left is cycles, which are cut before their least piece."""

    def hop(step: DataFrame) -> DataFrame:
        """Each pointer as far again; there: its end has none, so it has arrived."""
        ends = step.select(F.col("piece").alias("_p"), F.col("path").alias("_path"), F.col("at").alias("_at"))
        far = step.join(ends, F.col("path") == F.col("_p"), "left")
        return far.select("piece", F.coalesce("_path", "path").alias("path"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.col("_path").isNull().alias("there"))

    step = links.select("piece", F.col("before").alias("path"), F.col("length").cast("long").alias("at"))
    left, rest = None, links.count()
    while rest and rest != left:
        step = pinned(hop(hop(step.select("piece", "path", "at"))))  # those that have arrived still carry others
        left, rest = rest, step.where("not there").count()
    left = rest
    done = step.where("there").select("piece", "path", "at") if left else step.select("piece", "path", "at")
    if left:
        ring = links.join(step.where("not there").select("piece"), "piece", "left_semi")
        heads = connected_components(ring, "piece", "before").where("node = component").select(F.col("node").alias("piece"))
        done = done.unionByName(jumped(pinned(ring.join(heads, "piece", "left_anti"))))
    return done


def _verified(spans: DataFrame, chains: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows GRANTED: of the distinct coordinates of spans those whose nodes the chains have, with the parts of paths that they are."""
    parts = F.sort_array(F.collect_list(F.struct("start", "n", "path", "at"))).alias("parts")
    pieces = pieces.groupBy("batch", "place").agg(parts)  # no more than a chain has edges
    held = chains.join(pieces, ["batch", "place"]).select("batch", "place", "n", "doc_id", "word", "nodes", "parts")
    # the questions of a batch whose passages many quote are shared by several tasks, each with the batch's chains
    shares = _small(spans.groupBy("src_batch").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("shares")))
    spans = spans.join(shares, "src_batch").withColumn("share", F.pmod(F.xxhash64("src_place", "n", "digest"), F.col("shares")).cast("int")).drop("shares")
    held = held.join(shares.withColumnRenamed("src_batch", "batch"), "batch").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    granted_as = _arrow(GRANTED)

    def verify(key: tuple, asked: pa.Table, chains: pa.Table) -> pa.Table:
        chains = chains.sort_by("place")
        first = chains["place"].to_numpy().astype(np.int64)
        lists, known = chains["nodes"].combine_chunks(), {}
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        out = []
        for x, place, n, digest in zip(*(asked[c].to_pylist() for c in SPAN), strict=True):
            c = int(np.searchsorted(first, place, side="right")) - 1
            if c < 0 or place - first[c] + n > offsets[c + 1] - offsets[c] - 1:
                continue
            skip = int(place - first[c])
            if _digest(values[offsets[c] + skip : offsets[c] + skip + n + 1]) != digest:
                continue
            if c not in known:
                known[c] = (chains["doc_id"][c].as_py(), chains["word"][c].as_py(), chains["parts"][c].as_py())
            doc, word, parts = known[c]
            own = []
            for p in parts:
                lo, hi = max(skip, p["start"]), min(skip + n, p["start"] + p["n"])
                if lo < hi:
                    own.append({"path": p["path"], "at": p["at"] + lo - p["start"], "start": lo - skip, "n": hi - lo})
            out.append({"src_batch": x, "src_place": place, "n": n, "digest": digest, "src_doc_id": doc, "src_word": word + skip, "parts": own})
        return pa.Table.from_pylist(out, granted_as)

    return spans.groupBy("src_batch", "share").cogroup(held.groupBy("batch", "share")).applyInArrow(verify, GRANTED)


def _spans(batches: _Batches) -> tuple[DataFrame, DataFrame]:
    """The verified spans (columns of FOUND, src_doc_id, src_word, parts) and windows that a second look found (batch, place, n)."""
    found = written(batches.found(), "found")
    chains, spans = found.where("nodes is not null").select("batch", "place", "n", "doc_id", "word", "nodes"), found.where("nodes is null").drop("nodes")
    asked = written(spans.select(*SPAN).distinct(), "asked")
    granted = written(_verified(asked, chains, compacted_paths(chains)), "granted")
    keys = granted.select(*SPAN)
    sure = spans.join(_small(granted) if asked.count() <= BROADCAST_ROWS // 10 else granted, SPAN)
    none = spans.select("batch", "place", "n").limit(0)
    if granted.count() == asked.count():
        return sure, none
    return sure, batches.second_look(spans.join(keys, SPAN, "left_anti").select("batch", "place", "n"))


def repeated_spans(docs: DataFrame, k: int = 13, batch_bytes: int = BATCH_BYTES, bucket_edges: int = BUCKET_EDGES, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """(doc_id, word, n_words, path, at, src_doc_id, src_word): the n_words words of a document from word on are a part of a compacted path, from its edge at on,
    which the document src_doc_id, with a smaller id, has from src_word on. Spans are as long as both the path and the source go on; those next to one another overlap by k-1 words.
    Windows that only a second look finds (see the module) have no path or source. Nulls and empty tables: see remove_repeats."""
    batches = _Batches(docs.select(doc_id, text), k, batch_bytes, bucket_edges, doc_id, text, hash_bits)
    sure, _ = _spans(batches)
    part = sure.withColumn("p", F.explode("parts"))
    return part.select("doc_id", (F.col("word") + F.col("p.start")).alias("word"), (F.col("p.n") + (k - 1)).alias("n_words"), "p.path", "p.at", "src_doc_id", (F.col("src_word") + F.col("p.start")).alias("src_word"))


def remove_repeats(docs: DataFrame, k: int = 13, batch_bytes: int = BATCH_BYTES, bucket_edges: int = BUCKET_EDGES, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """docs with columns kept_text (the words that stay, one space between them), n_words and n_removed (longs).

    A word goes if a window of k words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Null and empty texts have no words. A null doc_id is larger than any other;
    rows of one doc_id (or of none) don't count as earlier for one another, and those of one id lie in one batch. Other columns stay, but any of the
    three names above (and mf_batch) is replaced. Empty table: no rows. hash_bits: bits of the edges' hashes; fewer only make more second looks.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed", "mf_batch")
    batches = _Batches(docs, k, batch_bytes, bucket_edges, doc_id, text, hash_bits)
    sure, more = _spans(batches)
    spans = sure.select("batch", "place", "n").unionByName(more)
    out_schema = docs.select("*", F.lit("").cast("string").alias("kept_text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema

    def remove(key: tuple, b: pa.Table, spans: pa.Table) -> pa.Table:
        s = Stream(b, doc_id, text)
        n, docs_here = len(s.start), len(s.rows)
        depth = np.zeros(n + 1, np.int64)
        start = spans["place"].to_numpy().astype(np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + spans["n"].to_numpy() + k - 1, -1)
        gone = np.cumsum(depth[:n]) > 0
        words = np.bincount(s.doc, minlength=docs_here)
        removed = np.bincount(s.doc[gone], minlength=docs_here)
        # the bytes of a kept word and the space after it
        edge = np.zeros(len(s.buf) + 1, np.int64)
        np.add.at(edge, s.start[~gone], 1)
        np.add.at(edge, s.end[~gone] + 1, -1)
        left = s.buf[np.cumsum(edge[:-1]) > 0].tobytes()
        size = np.bincount(s.doc[~gone], weights=(s.end - s.start + 1)[~gone], minlength=docs_here).astype(np.int64)
        ends = np.cumsum(size)
        kept = [left[e - z : max(e - 1, e - z)].decode("utf-8", "surrogatepass") for e, z in zip(ends.tolist(), size.tolist(), strict=True)]
        b = b.drop_columns(["mf_batch"]).take(pa.array(s.rows))
        return b.append_column("kept_text", pa.array(kept, pa.string())).append_column("n_words", pa.array(words, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return batches.placed.groupBy("mf_batch").cogroup(spans.groupBy("batch")).applyInArrow(remove, out_schema)
