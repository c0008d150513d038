"""A corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, best-fit packing.

Every stage works on all rows that the one before it kept. Rows with a null doc_id stay in the corpus: the
near-dedup cannot tell them apart, so that it keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.packing import pack
from tablewright.llm.q1 import tokenizer_path
from tablewright.llm.shared import written
from tablewright.llm.simhash import simhash_groups
from tablewright.llm.suffix_dedup import cut_repeats
from tablewright.llm.toxicity import keep_clean

#: SQL cannot express the classifier and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts to be toxic go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays; rows that repeat its doc_id are that document."""
    groups = simhash_groups(docs)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has are cut out; what is left of a split character goes too."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = cut_repeats(docs, carry=rest, with_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", clean_stage),
    ("simhash_dedup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
