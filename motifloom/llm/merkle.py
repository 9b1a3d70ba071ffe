"""Document fingerprints: a Merkle tree over blocks of words, paragraphs and sections.

A text is cut losslessly: paragraphs at newlines, words at single spaces. A paragraph's blocks are cut by content: about one word
in four begins a block, as its first letter, its length and the first letter of the word before say, so that an edit moves no cut
but those beside it; only a block of over 64 words is cut again each 64 words. A leaf is a block's SHA-256, a paragraph's node that of its leaves, a section's
node that of its paragraphs' nodes, and the root that of the sections' nodes; a section ends after a paragraph whose node says so, one in
four. All these are whole digests, so equal roots mean equal texts, and where branches differ the texts do.

A fingerprint is root:sections, with "|" between sections; a section is node=paragraphs, with "." after each paragraph; a paragraph is
node-leaves, with "," between leaves. Below the root, 16 hex digits of a node and 8 of a leaf are shown: they serve likeness and
the place of an edit, not equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.common import partitions, range_buckets

ROOT, NODE, LEAF = 64, 16, 8
#: Words of a block at most.
BLOCK = 64
BUCKET_BYTES = 16 << 20


def _let(value: Column, of) -> Column:
    """of(value), value computed once."""
    return F.transform(F.array(value), of)[0]


def _blocks(words: Column) -> Column:
    n = F.size(words)
    cut = lambda i: (5 * F.ascii(words[i]) + 3 * F.length(words[i]) + F.ascii(words[i - 1])) % 4 == 0
    new = F.filter(F.sequence(F.lit(1), n - 1), cut)
    starts = F.concat(F.array(F.lit(0)), F.when(n > 1, new).otherwise(F.array().cast("array<int>")))
    join = lambda part: F.array_join(part, " ")

    def whole(b: Column) -> Column:
        again = F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / F.lit(BLOCK)).cast("int")), lambda t: join(F.slice(b, t * BLOCK + 1, BLOCK)))
        return F.when(F.size(b) <= BLOCK, F.array(join(b))).otherwise(again)

    parts = _let(starts, lambda at: F.transform(at, lambda s, j: F.slice(words, s + 1, F.coalesce(F.get(at, j + 1), n) - s)))
    return F.flatten(F.transform(parts, whole))


def _paragraph(paragraph: Column) -> Column:
    """The whole node, and what the fingerprint shows, each with its separator."""
    leaves = F.transform(_let(F.split(paragraph, " ", -1), _blocks), lambda b: F.sha2(b, 256))

    def of(own: Column) -> Column:
        return F.struct(F.sha2(F.array_join(own, ""), 256).alias("node"), F.array_join(F.transform(own, lambda x: F.substring(x, 1, LEAF)), ",").alias("leaves"))

    def ended(p: Column) -> Column:
        end = F.when(p["node"] < "4", "|").otherwise(".")
        return F.struct(F.concat(p["node"], end).alias("node"), F.concat(F.substring(p["node"], 1, NODE), F.lit("-"), p["leaves"], end).alias("shown"))

    return _let(_let(leaves, of), ended)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text counts as an empty one."""
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _paragraph)

    def sections(p: Column) -> Column:
        by = lambda name: F.filter(F.split(F.array_join(F.transform(p, lambda x: x[name]), ""), r"\|", -1), lambda s: s != "")
        return F.struct(F.transform(by("node"), lambda s: F.sha2(s, 256)).alias("nodes"), by("shown").alias("shown"))

    def rooted(s: Column) -> Column:
        shown = F.transform(s["nodes"], lambda node, i: F.concat(F.substring(node, 1, NODE), F.lit("="), s["shown"][i]))
        return F.concat(F.sha2(F.array_join(s["nodes"], ""), 256), F.lit(":"), F.array_join(shown, "|"))

    return _let(_let(paragraphs, sections), rooted)


def _below(fp: Column) -> Column:
    return F.substring(fp, ROOT + 2, 1 << 30)


def leaves_of(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_below(fp), "[|=.,-]"), lambda x: F.length(x) == LEAF))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1: twice the leaves that both have over the leaves of either (Dice); 1 for equal roots."""
    same = F.substring(a, 1, ROOT) == F.substring(b, 1, ROOT)
    dice = lambda x: 2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"]))
    return F.when(same, 1.0).otherwise(_let(F.struct(leaves_of(a).alias("a"), leaves_of(b).alias("b")), dice))


def _differing(a: Column, b: Column, nodes) -> Column:
    numbered = F.transform(nodes(a), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return _let(nodes(b), lambda other: F.transform(F.filter(numbered, lambda x: ~F.array_contains(other, x["s"])), lambda x: x["i"]))


def differing_sections(a: Column, b: Column) -> Column:
    """The positions (from 0) of the sections of a whose node b doesn't have: where a's text was edited. Empty for equal roots."""
    return _differing(a, b, lambda fp: F.transform(F.split(_below(fp), r"\|", -1), lambda s: F.substring(s, 1, NODE)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """The positions (from 0) of the paragraphs of a whose node b doesn't have."""
    return _differing(a, b, lambda fp: F.transform(F.filter(F.split(_below(fp), "[|=.]"), lambda s: F.substring(s, NODE + 1, 1) == "-"), lambda s: F.substring(s, 1, NODE)))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text and carried) with next_<column> of the document that follows in descending doc_id; the first follows the last.

    Documents lie in ranges of doc_id; the first of each range also goes, as a sentinel, to the range before, so
    that each range is ordered alone. Nulls come last, equal ids in the order of a hash of the text and of the text; the
    rows of one id are ordered in one task. Names that begin with mf_ are its own: docs must not have them.
    """
    size = F.octet_length("text")
    sums = docs.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("doc_id").isNull(), size)).alias("none")).first()
    n = max(4 * partitions(docs.sparkSession), (sums["all"] or 0) // BUCKET_BYTES)
    # rows without an id follow all others, in the order of a hash, so that they can be divided too: into buckets -1, -2 and on
    th, none = F.xxhash64("text"), 1 + (sums["none"] or 0) // BUCKET_BYTES
    part = F.least(F.floor((th.cast("double") / 2.0**64 + 0.5) * none), F.lit(none - 1)).cast("int")
    rows = range_buckets(docs, "doc_id", "mf_bucket", n).withColumn("mf_bucket", F.when(F.col("doc_id").isNull(), -1 - part).otherwise(F.col("mf_bucket"))).withColumn("mf_hash", th)
    first = F.when(F.col("mf_bucket") < 0, F.col("mf_hash"))
    tops = rows.groupBy("mf_bucket").agg(F.max("doc_id").alias("mf_top"), F.min(first).alias("mf_first"))  # one row a range
    up = Window.partitionBy(F.lit(0)).orderBy("mf_bucket")
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.withColumn("mf_above", F.coalesce(F.lead("mf_bucket").over(up), F.min("mf_bucket").over(whole)))
    tops = tops.select(F.col("mf_bucket").alias("mf_b"), "mf_top", "mf_first", "mf_above")
    at = (rows["mf_bucket"] == tops["mf_b"]) & rows["doc_id"].eqNullSafe(tops["mf_top"]) & (tops["mf_first"].isNull() | (rows["mf_hash"] == tops["mf_first"]))
    here = F.struct(F.col("mf_bucket").alias("b"), F.lit(False).alias("sentinel"))
    there = F.struct(F.col("mf_above").alias("b"), F.lit(True).alias("sentinel"))
    sent = rows.join(F.broadcast(tops), at, "left").withColumn("mf_to", F.explode(F.when(F.col("mf_above").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("mf_to.b").orderBy("mf_to.sentinel", F.col("doc_id").desc_nulls_last(), "mf_hash", "text")
    led = sent.select(*docs.columns, "mf_hash", "mf_to").withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return led.where("not mf_to.sentinel").drop("mf_to", "mf_hash")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    edited_text is the text with its last third, floor(n_chars / 3) code points, replaced by the first as many of the next
    document (all of them where it has fewer). Null texts are empty, null ids come last. Repeated rows are all returned; other columns
    are ignored. An empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    led = with_next(own, ["text", "fingerprint"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    led = led.withColumns({"n_chars": n.cast("long"), "edited_text": edited}).withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    fp = F.col("fingerprint")
    return led.select("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", likeness(fp, F.col("edited_fingerprint")).alias("near_edited"), likeness(fp, F.col("next_fingerprint")).alias("near_next"))
