"""From raw documents to packed training sequences, one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gets what its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlake.llm import line_dedup, packing, parity_join, pii, quality
from seasonlake.session import pinned


def with_text(row: str, text: str, columns: list[str]) -> Column:
    """The struct ``row`` with a new text and, where there is one, its length in n_chars."""
    out = F.col(row).withField("text", F.col(text))
    return out.withField("n_chars", F.length(F.col(text)).cast("long")) if "n_chars" in columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade; poor and toxic ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return quality.score_documents(docs, labels).where("keep").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay once; documents left without a line go.

    A document that had no visible text before is kept as it was.
    """
    kept = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    rows = kept.where(~emptied).select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return rows.select(with_text("row", "text", docs.columns).alias("row")).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return parity_join.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; every document stays."""
    found = pii.find_pii(docs)
    return found.select(with_text("row", "masked", docs.columns).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the personal data patterns can be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
