"""What several operators use: cut lineage, connected components, local union-find."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    This cuts the lineage; the files outlive any executor.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n items under the undirected edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def components(edges: DataFrame, node: str = "node", root: str = "root", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the long edges (a, b): root is its component's smallest node.

    Alternating large-star and small-star steps, each an aggregate and a join, so a
    hub is never gathered in one group. Nodes without edges do not appear.
    Raises RuntimeError if `rounds` steps do not reach the fixed point.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct()
        .checkpoint()
    )
    digest = _digest(e)
    for _ in range(rounds):
        if digest[0] == 0:
            break
        # Large star: every neighbour above a node joins the smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = big.filter("u > v").distinct()
        # Small star: a node and its smaller neighbours join the smallest of them.
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        moved = kept.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        e = small.filter("u > v").distinct().checkpoint()
        now = _digest(e)
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias(node), F.col("v").alias(root))
    roots = e.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
    return stars.unionByName(roots)


def _digest(e: DataFrame) -> tuple:
    return tuple(
        e.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string"),
        ).first()
    )
