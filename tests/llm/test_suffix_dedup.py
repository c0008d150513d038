import hashlib

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import suffix_dedup as s


def brute(rows):
    """Sorted result rows, from a table of all 50-byte strings."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    alphabet = list("abcdé ñ")

    def text(n):
        return "".join(rng.choice(alphabet, n))

    shared = [text(n) for n in (49, 50, 51, 70, 120, 300)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts.append(text(rng.integers(0, 90)))
            if rng.random() < 0.7:
                p = shared[rng.integers(len(shared))]
                a, b = sorted(rng.integers(0, len(p) + 1, 2))
                parts.append(p if rng.random() < 0.6 else p[a:b])
        rows.append((int(d * 7 % 80), "".join(parts)))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, "a" * 300), (104, "b" * 20 + "a" * 120), (105, "ab" * 90)]
    rows += [(105, "ab" * 90), (106, "x" * 10 + "ab" * 60), (None, rows[3][1]), (None, None), (107, text(5) * 60), (108, text(40_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash")).repartition(6)
    assert rows_of(s.cut_repeats(df)) == brute(rows)


def headed(n):
    """Documents with a common header and different continuations, and a passage with different surroundings."""
    rng = np.random.default_rng(6)
    text = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    header, passage = text(200), text(75)
    return [(int(d), header[: int(rng.integers(150, 201))] + text(int(rng.integers(0, 60))) + (passage + text(30) if d % 2 else text(9))) for d in rng.permutation(n)]


def test_frequent_leading_bytes_are_compared_by_windows(spark, monkeypatch):
    rows = headed(120)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(s.cut_repeats(df)) == want
    monkeypatch.setattr(s, "SAMPLE_SHARE", 1.0)
    # Some leading bytes, then all of them.
    for anchors in (64, 1):
        monkeypatch.setattr(s, "HOT_ANCHORS", anchors)
        monkeypatch.setattr(s, "HOT_SHARE", 0.0)
        hot = s._splitters(df.select(F.col("text").cast("binary").alias("body")), 8)[1]
        assert len(hot) > (0 if anchors > 1 else 200)
        assert rows_of(s.cut_repeats(df)) == want


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(7)
    long = "".join(rng.choice(list("abcdefghijklmnop"), s.CHUNK_BYTES + 40_000))
    edge = s.CHUNK_BYTES
    rows = [(1, long), (0, long[edge - 40 : edge + 35] + "zz" + long[edge - 300 : edge + 10] + "y" + long[5:60]), (2, "q" + long[edge - 60 : edge + 60]), (3, long[edge + 100 :])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(s.cut_repeats(df)) == brute(rows)


def test_empty_table(spark):
    assert s.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = s.multikey_order(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))
