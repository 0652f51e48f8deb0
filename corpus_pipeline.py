"""Training corpus: documents -> toxicity -> near duplicates -> benchmark decontamination -> personal data -> packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshcast.llm.common import fresh_path, staged
from meshcast.llm.decontamination import decontaminate
from meshcast.llm.ngram_jaccard import ngram_jaccard_join
from meshcast.llm.packing import packed
from meshcast.llm.pii import redacted
from meshcast.llm.queries import table, tokenizer_path
from meshcast.llm.toxicity import toxicity_scores


def _own(docs: DataFrame) -> list:
    """The columns of `docs`, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = toxicity_scores(docs.select(F.struct("*").alias("own"), "doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.where("predicted = 0").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest doc_id. Rows are told apart by a stored number, so repeated
    rows, rows that share a doc_id and rows without one are documents like others; texts without words link with nothing and stay."""
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard_join(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every found span of their text replaced by its kind; n_chars is that of the new text."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*_own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in their sequences."""
    return packed(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Learnt models and packing cannot be written in SQL; tests/llm/test_pipeline.py compares the stages with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
