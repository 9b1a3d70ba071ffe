"""Chat formatting: logged snapshots of a growing conversation collapse to the longest, which is rendered.

A prefix of a conversation is identified by its length and two 64-bit hashes that roll over the turns (the
exclusive-or of position-tagged turn hashes). A conversation whose whole hash is a shorter prefix of another
one is dropped by an anti-join; of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hashed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, t1, t2: two hashes of a turn's role and text; null ones differ from empty ones."""
    parts = [F.col("role").isNull(), F.col("text").isNull(), F.length("role"), F.col("role"), F.col("text")]
    return turns.select("conv_id", "turn", "role", "text", F.md5("text").alias("tie"), F.xxhash64(F.lit(1), *parts).alias("t1"), F.xxhash64(F.lit(2), *parts).alias("t2"))


def _alone(turns: DataFrame) -> DataFrame:
    """h1, h2, role, text of the turns without a conv_id, equal ones once: each is a conversation of its own."""
    rows = _hashed(turns.where("conv_id is null")).select(*(F.xxhash64(F.lit(1), t).alias(h) for h, t in (("h1", "t1"), ("h2", "t2"))), "role", "text")
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("role", "text")).alias("x")).select("h1", "h2", "x.role", "x.text")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (of the turns up to pos), n (turns of the conversation), c1, c2 (of all its turns), without the texts.

    Turns are ordered by (turn, role, MD5 of text), nulls first. Null roles and texts differ from empty ones. Turns without a conv_id can't be told
    to belong together: each is a conversation of one turn, equal ones are one.
    """
    rows = _hashed(turns.where("conv_id is not null")).drop("text")
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "tie")
    rows = rows.withColumn("pos", F.row_number().over(order))
    rows = rows.withColumns({t: F.xxhash64("pos", t) for t in ("t1", "t2")})
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"h1": F.bit_xor("t1").over(upto), "h2": F.bit_xor("t2").over(upto)})
    rows = rows.withColumns({"n": F.max("pos").over(whole), "c1": F.bit_xor("t1").over(whole), "c2": F.bit_xor("t2").over(whole)})
    one = _alone(turns).select(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).alias("pos"), "h1", "h2", F.lit(1).alias("n"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    return rows.select("conv_id", "pos", "h1", "h2", "n", "c1", "c2").unionByName(one)


def maximal(rows: DataFrame) -> DataFrame:
    """(keep_id, n, c1, c2): of rows with_prefixes, the conversations that no longer one continues; of equal ones the smallest conv_id (nulls last)."""
    ends = rows.where("pos = n").groupBy("n", "c1", "c2").agg(F.min("conv_id").alias("keep_id"))
    # one row for each distinct prefix, so that a first turn shared by many conversations is one key once
    prefixes = rows.where("pos < n").groupBy(F.col("pos").alias("n"), F.col("h1").alias("c1"), F.col("h2").alias("c2")).agg(F.lit(True).alias("longer"))
    return ends.join(prefixes, ["n", "c1", "c2"], "left_anti")


def chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, h1, h2, kept (bool). Kept are the conversations that no longer one
    continues and that have the smallest conv_id (nulls last) among equals.

    For turns without a conv_id see with_prefixes. Repeated turns are turns of their own. Extra columns are ignored. Empty table: no rows.
    """
    rows = with_prefixes(turns)
    keep = maximal(rows).select("keep_id", F.col("n").alias("_n"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.lit(True).alias("_kept"))
    same = F.col("conv_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("_n")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))
    every = rows.where("pos = n").select("conv_id", "n", "c1", "c2").join(keep, same, "left")
    return every.select("conv_id", F.col("n").alias("n_turns"), F.col("c1").alias("h1"), F.col("c2").alias("h2"), F.coalesce("_kept", F.lit(False)).alias("kept"))


def format_chats(turns: DataFrame, render=chatml) -> DataFrame:
    """conv_id, n_turns, text for each maximal conversation of turns (conv_id, turn, role, text).

    text joins the rendered turns in order. Null roles and texts render as empty. Repeated turn rows are turns of
    their own; turns without a conv_id are conversations of one turn, equal ones one. A conversation's turns are ordered in one task, and its text is one
    string. Extra columns are ignored; an empty table gives no rows.
    """
    keep = maximal(with_prefixes(turns))
    ids = keep.where("keep_id is not null").select("keep_id")
    kept = turns.select("conv_id", "turn", "role", "text").join(ids, F.col("conv_id") == F.col("keep_id"), "left_semi")
    turn = F.struct("turn", "role", F.md5("text").alias("tie"), render(F.col("role"), F.col("text")).alias("t"))
    whole = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]), "").alias("text"))
    none = keep.where("keep_id is null and n = 1").select(F.col("c1").alias("h1"), F.col("c2").alias("h2"))
    one = _alone(turns).join(none, ["h1", "h2"], "left_semi")
    return whole.unionByName(one.select(F.lit(None).cast(whole.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), render(F.col("role"), F.col("text")).alias("text")))
