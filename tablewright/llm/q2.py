"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.q1 import tokenizer_path
from tablewright.llm.sentencepiece_codec import digests


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, tokenizer_path("piece_bpe_32k.model"))
