"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.toxicity import toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by their nearest labelled examples, which are the evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels)
