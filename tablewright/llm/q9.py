"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.simhash import simhash_groups


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and groups."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
