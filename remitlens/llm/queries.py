"""The operators of this package bound to the supplied tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import (
    context_tree,
    decontaminate,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_rules,
    spelling,
    substring_dedup,
    warc,
    whitening,
)
from remitlens.llm.store import pinned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in any document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 4-word shingles at Jaccard 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@_query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows, over all documents."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=20)


@_query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs whose tiles cover at least half of the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op5_quality_rules", quality_rules.SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, with cutoffs certified per language."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a network trained on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", F.coalesce(~language_id.learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@_query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, disguised forms included."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    folder = warc.archive_folder(spark)
    written = pinned(warc.write_archives(table(spark, sf_dir, "pages"), folder), "archives")
    return warc.read_archives(written, folder, blocks=False).drop("block", "url")


@_query("op9_line_dedup", line_dedup.SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated three-line windows of all documents; the kept text as SHA-256."""
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the leading components of their distinct grid vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors, components=16)
    return whitening.components(model, whitening.whiten(vectors, model))


@_query("op12_context_tree")
def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those that are not held out."""
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    return context_tree.score(table(spark, sf_dir, "documents"), learn=part != 2, held_out=part == 2)


@_query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants at one edit."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")
