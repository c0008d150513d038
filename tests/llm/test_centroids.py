import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import centroids, q11

NAN, INF = float("nan"), float("inf")


def make(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("v", F.lit("clash")).withColumn("cluster", F.lit(7)).withColumn("sums", F.lit(1)).repartition(5)


def usable(x, dims):
    return x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)


def brute(rows, clusters, rounds, dims):
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    kept = sorted(((i, x) for i, x in rows if usable(x, dims)), key=lambda r: (digest(r[0]), r[1]))
    ints = [[math.floor(Fraction(c) * 256) for c in x] for _, x in kept]
    centres = ints[:clusters]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for v in ints]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(centres)):
            if mine := [v for v, (_, k) in zip(ints, at, strict=True) if k == j]:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at, by = assigned(), {}
    for d, j in at:
        by[j] = by.get(j, 0) + d
    fit = lambda n: n if n < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, fit(d), fit(by[j]), fit(sum(by.values())), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        x = rng.normal(size=6) * rng.choice([0.01, 1.0, 30.0])
        rows.append((i, [float(np.float32(c)) for c in x]))
    # Coarse ones tie with many centroids; one of them holds a third of all rows.
    rows += [(300 + i, [float(c) for c in rng.integers(-1, 2, size=6) / 256]) for i in range(100)]
    rows += [(400 + i, [0.5] * 6) for i in range(200)]
    want = brute(rows, 12, 4, 6)
    assert got(centroids.cluster_vectors(make(spark, rows), 12, 4, 6)) == want
    assert len({r[1] for r in want}) > 5


def test_annulus_keeps_ties_on_its_boundary():
    # Both centroids are as far from the vector, one at either edge of its annulus.
    ring = centroids.Ring([[9, 0], [3, 0], [0, 6], [-100, 0], [-100, 0]])
    number, apart = ring.nearest(np.array([[6.0, 0.0], [0.0, 0.0], [-100.0, 0.0], [3.0, 3.0]]))
    assert number.tolist() == [0, 1, 3, 1]
    assert apart.tolist() == [9, 9, 0, 9]


def test_annulus_equals_all_distances():
    rng = np.random.default_rng(3)
    for spread in (1, 10, 1 << 19):
        rows = rng.integers(-spread, spread + 1, size=(40, 5))
        x = rng.integers(-spread, spread + 1, size=(2000, 5))
        number, apart = centroids.Ring(rows.tolist()).nearest(x.astype(float))
        all_of = ((x[:, None, :] - rows[None]) ** 2).sum(axis=2)
        assert (number == all_of.argmin(axis=1)).all() and (apart == all_of.min(axis=1)).all()


def test_numbers_of_any_size(spark):
    rows = [(i, [float(i), -float(i)]) for i in range(20)]
    rows += [(20, [3e38, 1.0]), (21, [-3e38, 2.0]), (22, [1e300, 0.0]), (23, [1.7e308, -1.7e308]), (24, [1e9, 7.0]), (25, [1e9, 8.0]), (26, [5e-324, 0.0])]
    want = brute(rows, 6, 3, 2)
    assert got(centroids.cluster_vectors(make(spark, rows, "double"), 6, 3, 2)) == want
    assert any(r[2] is None for r in want) and any(r[2] is not None for r in want)


def test_odd_tables(spark):
    assert centroids.cluster_vectors(make(spark, []), 3, 2, 2).collect() == []
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [1.0, -INF]), (7, [1.0, 2.0, 3.0])]
    assert centroids.cluster_vectors(make(spark, bad), 3, 2, 2).collect() == []
    # Fewer rows than clusters, repeated and null ids, equal centroids: the smaller number takes all.
    rows = [*bad, (8, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.5]), (None, [0.0, 0.0]), (None, [1.0, 2.0])]
    df = centroids.cluster_vectors(make(spark, rows), 40, 5, 2)
    assert got(df) == brute(rows, 40, 5, 2)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ids_of_any_type(spark):
    rows = [(f"id {i}", [float(i % 3), 1.0]) for i in range(9)]
    df = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 3, 2, 2)
    assert got(df) == brute(rows, 3, 2, 2)


def test_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    mine = got(q11.op11_centroid_clusters(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert mine == sorted(con.sql(q11.SQL).fetchall(), key=str)
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert mine == brute(rows, 40, 5, 64)
