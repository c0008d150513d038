"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.html_text import main_text


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
