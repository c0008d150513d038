import duckdb
import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import embedding_dedup, q4, q5, topk

NAN = float("nan")


def make(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("n", F.lit("clash")).withColumn("v", F.lit(1)).repartition(5)


def vectors(seed, n, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        x = rng.normal(size=d)
        for _ in range(rng.integers(1, 5)):
            y = x + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.3])
            rows.append((len(rows), [float(np.float32(c)) for c in y], int(rng.integers(0, 3))))
    extra = [None, [], [0.0] * d, [NAN] * d, [1.0] * (d - 1) + [None], [float("inf")] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(len(rows) + i, e, 1) for i, e in enumerate(extra)]
    rows.append((len(rows), rows[0][1], None))
    return rows


def valid(x):
    return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x)


def brute_links(rows):
    ok = [valid(x) and any(x) and lab is not None for _, x, lab in rows]
    link = {i: set() for i in range(len(rows))}
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows[:i]):
            if ok[i] and ok[j] and a == b and len(x) == len(y):
                p, q = np.array(x), np.array(y)
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.98:
                    link[i].add(j)
                    link[j].add(i)
    out = []
    for i in link:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(link[i]), c, rows[i][0] == c))
    return sorted(out)


def test_near_vectors_against_brute_force(spark, monkeypatch):
    rows = vectors(1, 240)
    want = brute_links(rows)
    assert any(n > 1 for _, n, _, _ in want)
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(make(spark, rows)).collect()) == want
    # Many axes, tiles and shares.
    for cells in (12, 60):
        monkeypatch.setattr(embedding_dedup, "TILE_CELLS", cells)
        monkeypatch.setattr(embedding_dedup, "VISITORS", 1)
        monkeypatch.setattr(embedding_dedup, "LEAST_TILE", 2)
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(make(spark, rows)).collect()) == want


def test_near_vectors_odd_tables(spark):
    assert embedding_dedup.near_vectors(make(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, None, None)]
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(make(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, False), (3, 0, 3, True)], key=str)


def duck(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.sql(sql).fetchall(), key=str)


REPEATED = [
    (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 2), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (0, [0.0, 0.0], 1),
    (0, [2.0, 0.0], 1), (0, [0.5], 1), (None, [1.0, 0.0], 1), (5, [], 1), (5, [], 1), (6, None, 1), (8, [1.0, NAN], 1),
]


def test_repeated_ids_are_vectors_of_their_own(spark):
    got = embedding_dedup.near_vectors(make(spark, REPEATED)).select("vec_id", "n_links", "component_id", "kept").collect()
    got = sorted((tuple(r) for r in got), key=str)
    assert got == duck(q4.SQL, REPEATED)
    assert [r for r in got if r[0] == 1] == [(1, 1, 1, True), (1, 3, 0, False)]
    assert [r for r in got if r[0] == 4] == [(4, 3, 0, False)] * 2

    got = topk.top_products(make(spark, REPEATED), F.col("vec_id") % 4 == 0).collect()
    got = sorted((tuple(r) for r in got), key=str)
    assert got == duck(q5.SQL.replace("% 100", "% 4"), REPEATED)
    assert len([r for r in got if r[0] == 4]) == 16


def test_top_products_against_brute_force(spark, monkeypatch):
    rows = vectors(2, 400)
    good = [(i, np.floor(1024 * np.array(x))) for i, x, _ in rows if valid(x)]
    want = []
    for i, q in good:
        if i % 7 == 0:
            s = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:10]
            want += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s)]
    for block in (8192, 40):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "PART", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block // 2)
        monkeypatch.setattr(topk, "SEEDS", 30)
        got = topk.top_products(make(spark, rows), F.col("vec_id") % 7 == 0)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_products_odd_tables(spark):
    assert topk.top_products(make(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 1), (None, [1.0], 1), (4, None, 1)]
    got = sorted(tuple(r) for r in topk.top_products(make(spark, rows), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024), (0, 3, None, 1024 * 1024)]
