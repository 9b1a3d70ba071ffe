"""A corpus pipeline: five stages, each an operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import decontaminate, packing, queries, simhash, substrings, toxicity
from motifloom.llm.common import own_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model learns from docs with labels, of the folds that op7 learns from.

    Every row is judged by its text alone: null ids and repeated rows make no difference, null and empty texts score as texts without a
    feature and stay. Without a toxic label all rows stay. Empty table: no rows. Other columns than COLUMNS go, in all but the last stage."""
    model = queries.toxicity_model(spark, sf_dir, docs)
    return toxicity.scores(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more on five-word shingles: that of the smallest id, null ids last, of equal
    ids the first by text. Null and empty texts, and those without a word, are one group. Empty table: no rows."""
    return simhash.drop_near_duplicates(docs, k=5, similarity=0.8).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages that start in one with a smaller id; a text that loses nothing stays as it is (null, too), one that loses all its words goes.

    A null id is larger than any other, and rows of one id, or of none, aren't earlier for one another. n_chars is counted anew for texts that lose words. Empty table: no rows."""
    found = substrings.remove_repeats(docs, k=13)
    cut = F.col("n_removed") > 0
    found = found.where("n_removed = 0 or n_removed < n_words")
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumns({"text": text, "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to four fifths of its five-word shingles. Rows are judged one by one, also those with a null or repeated id; null
    and empty texts stay. Empty tables: no rows, or all of docs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences of 2048 tokens. Null texts are empty: one token, the end. Rows with a
    null or repeated id are packed one by one. Empty table: no rows."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = own_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
