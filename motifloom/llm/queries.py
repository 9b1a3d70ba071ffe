"""The queries over this subpackage's operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import chat, decontaminate, language, merkle, packing, simhash, sql, substrings, toxicity, url_filter, warc
from motifloom.llm.common import fold, own_dir, table

RULES = [url_filter.Rule("block", "com/en/"), url_filter.Rule("allow", "example.com/en/7"), url_filter.Rule("block", "net/de/"), url_filter.Rule("block", "example.net/de/8"), url_filter.Rule("block", "org/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    learn = docs.where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.fit(learn, table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scores(docs, toxicity_model(spark, sf_dir, docs))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), F.col("nearest").alias("lang_pred"), F.col("lang_score").alias("score"), "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), contained=0.8, k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op5_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, k=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    every = (op1_url_filter, op2_language_id, op3_decontamination, op4_best_fit_packing, op5_merkle_fingerprint, op6_substring_dedup, op7_toxicity, op8_chat_formatting, op9_warc, op10_simhash)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL has no classifiers (op2, op7), tokenizer (op4) or XXH64 (op10); their tests hold them against brute force."""
    return {"op1_url_filter": sql.op1(RULES), "op3_decontamination": sql.OP3, "op5_merkle_fingerprint": sql.OP5, "op6_substring_dedup": sql.OP6, "op8_chat_formatting": sql.OP8, "op9_warc": sql.OP9}
