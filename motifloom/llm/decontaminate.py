"""Benchmark decontamination: short test items found inside long documents by containment.

An item of q distinct shingles is contained to a part t if a document has at least ceil(t q) of them, so at most
q - ceil(t q) are missing: of its q - ceil(t q) + 1 first hashes, its bottom-k MinHash sketch, one at least is in the document.
The order of the sketch is by the number of items that have the shingle, and then by hash: a phrase that many items share is in
a sketch only where an item has nothing rarer, so it doesn't pair every document that has it with all of them.
Items are partitioned by size (powers of two). A document probes the partitions whose items it is large enough to
contain, each by that partition's hashes. So no containing pair is missed, and what is found is verified with the shingles themselves.
Before a document's hashes become rows they are looked up in a table of bytes, one for each class of sketch hashes, that only passes
over what can't be in any sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import pinned

SHINGLE = 5
CONTAINED = 0.8
#: Sketches, or candidates, of up to so many rows are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes of hashes that the table of bytes has at most.
CLASSES = 1 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null and for texts without one."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(w: str, k: int) -> Column:
    """The hash of each k-word shingle of column w."""
    n = F.size(w) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.col(w)[i + j] for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def shingles(w: str, k: int) -> Column:
    n = F.size(w) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_items(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, containment) of docs (doc_id, text) and items (item_id, text) with at least the part contained of an item's distinct k-word shingles.

    An item of fewer than k words is one shingle of all its words. Items and documents without a word match nothing. Every row counts, also those with
    a null id: those of one doc_id (or of none) and one item_id (or of none) give one row, with the greatest containment. Extra columns are ignored.
    Empty tables: no rows.
    """
    found, names = _matches(docs, items, contained, k)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")
    named = found.join(names, "tid").select("doc_id", "item_id", "containment")
    return named.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, k: int = SHINGLE) -> DataFrame:
    """docs without the rows that find_items would name. Rows are judged one by one, so those with a null or repeated doc_id, too."""
    found, _ = _matches(docs, items, contained, k)
    if found is None:
        return docs
    gone = pinned(found.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th"))
    return docs.withColumn("_th", F.xxhash64("text")).join(small(gone, gone.count()), same, "left_anti").select(*docs.columns)


def _matches(docs: DataFrame, items: DataFrame, contained: float, k: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(doc_id, th, tid, containment) by row of docs, th the hash of its text, and (tid, item_id): tid numbers distinct texts of items. Nones without an item."""
    item = pinned(items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0"))
    forms = pinned(item.select("w").distinct().withColumn("tid", F.monotonically_increasing_id()).withColumn("k", F.least(F.size("w"), F.lit(k))))
    widths = sorted(r["k"] for r in forms.select("k").distinct().collect())  # k numbers at most
    if not widths:
        return None, None
    names = item.join(forms.select("w", "tid"), "w").select("tid", "item_id").distinct()

    by_width = lambda of, w="w": F.coalesce(*(F.when(F.col("k") == x, of(w, x)) for x in widths))
    sets = forms.select("tid", "k", F.array_distinct(by_width(shingles)).alias("item_sh"), F.array_distinct(by_width(shingle_hashes)).alias("h"))
    q = F.size("item_sh")
    sets = sets.withColumns({"q": q, "least": F.ceil(F.lit(contained) * q - 1e-9).cast("int"), "part": F.floor(F.log2(q.cast("double"))).cast("int")})
    each = sets.select("tid", "k", "part", "q", "least", F.explode("h").alias("h"))
    common = each.groupBy("k", "h").agg(F.count(F.lit(1)).alias("items"))
    order = Window.partitionBy("tid").orderBy("items", "h")
    ranked = each.join(common, ["k", "h"]).withColumn("place", F.row_number().over(order))
    sketch = pinned(ranked.where("place <= q - least + 1").select("tid", "k", "part", "h", "least"))
    n_sketch = sketch.count()
    # of each size partition, how many shingles a document needs; k times a row for each power of two
    parts = sketch.groupBy("k", "part").agg(F.min("least").alias("least")).orderBy("k", "part").collect()

    probes = []
    for width in widths:
        own = sketch.where(F.col("k") == width)
        classes = min(CLASSES, 1 << (16 * own.count()).bit_length())
        table = bytearray(classes)
        for r in own.select(F.pmod("h", F.lit(classes)).alias("c")).distinct().collect():  # CLASSES numbers at most
            table[r["c"]] = 1
        listed = F.lit(bytes(table))
        known = lambda h: F.substring(listed, F.pmod(h, F.lit(classes)).cast("int") + 1, 1) == F.lit(b"\x01")  # noqa: B023, E731
        hits = F.array_distinct(F.filter(shingle_hashes("w", width), known))
        probes.append(F.transform(hits, lambda h: F.struct(F.lit(width).alias("k"), (F.size("w") - (width - 1)).alias("n"), h.alias("h"))))  # noqa: B023
    of_size = F.array(*(F.struct(F.lit(p["k"]).alias("k"), F.lit(p["part"]).alias("part"), F.lit(p["least"]).alias("least")) for p in parts))
    th = F.xxhash64("text").alias("th")
    probe = docs.select("doc_id", th, words(F.col("text")).alias("w")).select("doc_id", "th", F.explode(F.concat(*probes)).alias("p")).select("doc_id", "th", "p.*")
    probe = probe.withColumn("part", F.explode(F.filter(of_size, lambda p: (p["k"] == F.col("k")) & (p["least"] <= F.col("n"))))).select("doc_id", "th", "k", "n", "h", "part.part")
    candidates = pinned(probe.join(small(sketch, n_sketch), ["k", "part", "h"]).where("n >= least").select("doc_id", "th", "tid").distinct())
    n = candidates.count()

    wide = candidates.join(small(sets.select("tid", "k"), n_sketch), "tid")
    of_doc = wide.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "tid", F.col("k").alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))
    own_k = of_doc.select("c_id", "c_th", "k").distinct()
    texts = docs.select("doc_id", th, "text").join(small(own_k, n), same).select("doc_id", "th", "k", words(F.col("text")).alias("w"))
    # rows of equal id and text are one
    texts = texts.select("doc_id", "th", "k", F.array_distinct(by_width(shingles)).alias("doc_sh")).dropDuplicates(["doc_id", "th", "k"])
    pairs = texts.withColumnRenamed("k", "d_k").join(small(of_doc, n), same & (F.col("d_k") == F.col("k"))).select("doc_id", "th", "doc_sh", "tid")
    n_items = forms.count()
    own = sets.select(F.col("tid").alias("i_tid"), "item_sh")
    exact = pairs.join(F.broadcast(own) if n_items <= BROADCAST_ROWS // 100 else own, F.col("tid") == F.col("i_tid"))
    part = F.size(F.array_intersect("doc_sh", "item_sh")) / F.size("item_sh")
    return exact.select("doc_id", "th", "tid", part.alias("containment")).where(F.col("containment") >= contained - 1e-9), names
