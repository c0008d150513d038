"""Keyed upserts of a stream into versioned buckets of Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Buckets:
    """A table of one row a key, in `buckets` folders of which each has versions; a log says which version counts.

    A batch rewrites only the buckets that its keys fall into. Its rows are written before the log names them, so that a batch that breaks off leaves the table as it was;
    and a batch whose number the log has already changes nothing, so that replays are harmless. Null keys are dropped. Of several rows of a key the one with the
    largest `order` counts, within a batch and against what is stored; of equal ones that of the later batch. The path must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def _log(self) -> DataFrame:
        kind = "bucket int, version long"
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], kind)
            raise

    def _versions(self, buckets: list[int] | None = None) -> list[tuple[int, int]]:
        """(bucket, version) that count: at most one row a bucket."""
        log = self._log().filter("bucket >= 0")
        log = log if buckets is None else log.filter(F.col("bucket").isin(buckets))
        return [(r["bucket"], r["v"]) for r in log.groupBy("bucket").agg(F.max("version").alias("v")).collect()]

    def _stored(self, versions: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in versions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        """The table as it is now."""
        return self._stored(self._versions())

    def merge(self, batch: DataFrame, number: int) -> None:
        """Put a batch into the table, for foreachBatch."""
        if not self._log().filter(F.col("version") == number).isEmpty():
            return
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        fresh = batch.filter(F.col(self.key).isNotNull()).select(*self.schema.names, F.lit(1).alias("_side"))
        touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
        if touched:
            old = self._stored(self._versions(touched)).withColumn("_side", F.lit(0))
            row = F.struct(*self.schema.names)
            last = old.unionByName(fresh).groupBy(self.key).agg(F.max_by(row, F.struct(self.order, "_side")).alias("r")).select("r.*")
            last.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
        # Bucket -1 notes the batch itself, also if it was empty. One file, written last.
        log = self.spark.createDataFrame([(b, number) for b in [-1, *touched]], "bucket int, version long")
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def upserted(table: Buckets) -> Callable[[DataFrame, int], None]:
    """table.merge as foreachBatch wants it."""
    return lambda batch, number: table.merge(batch, number)
