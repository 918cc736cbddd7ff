"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage as Parquet in the
shared folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from remitlens.llm.queries import table, tokenizer_file
from remitlens.llm.store import pinned


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the network can tell; ``lang`` stays as it is.

    Undetermined texts (null, or without a letter) go, and texts that are likelier
    noise than their best language: gibberish, or a language that was not learned.
    The margin is a mean per position, so long texts are judged as short ones; its
    bound is set on all held-out rows.
    """
    net = language_id.train(docs)
    columns = docs.columns
    judged = language_id.identify(docs, net, with_margin=True).where(F.col("margin") >= language_id.margin_bound(docs, net))
    return judged.where(F.col("lang_pred") != language_id.UNDETERMINED).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line runs out of the texts; a text of which nothing is left goes.

    A text that is null or blank to begin with is not this stage's concern and stays.
    """
    cut = line_dedup.repeated_lines(docs).where("n_removed > 0").select("doc_id", "kept_text").distinct()
    placed = docs.join(cut.withColumnRenamed("doc_id", "_doc_id"), F.col("doc_id") == F.col("_doc_id"), "left")
    changed = F.col("kept_text").isNotNull()
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    kept = placed.where(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    counted = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[text.alias(c) if c == "text" else counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near-duplicates (5 words, 0.8)."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    gone = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: The language network and the tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
