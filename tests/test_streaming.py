import random

import pytest
from pyspark.sql import functions as F

from tablewright.streaming import diagnostics as t

SF = "/root/testdata/sf0.01"


def test_debounced_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    window = 24 * 3_600_000
    want = {(r.key, r.ms, r.gap_ms) for r in t.debounced(events, "key", "ms", "event_id", window).filter("emitted").collect()}
    src = str(tmp_path / "src")
    events.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = t.debounced_stream(stream, "key", "ms", window).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.ms, r.gap_ms) for r in spark.sql("SELECT * FROM debounced").collect()} == want


def test_rollup_stream_counts_closed_days(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    src = str(tmp_path / "src")
    events.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = t.rollup_stream(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT sum(n) AS n FROM rolled").first().n
    assert got == events.count()


def test_debounce_sequence(spark):
    rows = [("a", x, i) for i, x in enumerate([100, 1000, 1599, 1600, 3000, 3100, 9000])] + [("b", 5, 9)]
    df = spark.createDataFrame(rows, "k string, ms long, i int")
    got = t.debounced(df, "k", "ms", "i").orderBy("k", "ms").collect()
    assert [(r.ms, r.gap_ms) for r in got if r.emitted] == [(100, 0), (1600, 1500), (3100, 1500), (9000, 5900), (5, 0)]


def folded(rows, window):
    last, out = {}, {}
    for k, ms, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or ms - last[k] >= window:
            out[k, ms, i] = ms - last[k] if k in last else 0
            last[k] = ms
    return out


@pytest.mark.parametrize("step", [(1, 1), (0, 9), (1, 400)])
def test_hot_key_is_folded_in_parts(spark, step):
    """Steady times (chains that never meet), dense random times and sparse ones; a null key, null times, ties, negative times."""
    pick, rows, ms = random.Random(step[1]), [], -700
    for i in range(3000):
        ms += pick.randint(*step)
        rows.append((pick.choice(["hot"] * 8 + ["b", "c", None]), ms, i))
    rows += [(k, ms - 50, 5000 + i) for i, k in enumerate(["hot", "hot", None])] + [("hot", None, 6000), (None, None, 6001), ("once", 4, 6002)]
    df = spark.createDataFrame(rows, "k string, ms long, i int")
    for window in (1, 97, 100_000_000):
        got = t.debounced(df, "k", "ms", "i", window, part_rows=150).collect()
        assert len(got) == len(rows)
        assert {(r.k, r.ms, r.i): r.gap_ms for r in got if r.emitted} == folded(rows, window)
        assert all(r.gap_ms is None for r in got if not r.emitted)


def test_debounce_of_nothing_and_of_numeric_keys(spark):
    assert t.debounced(spark.createDataFrame([], "k long, ms long, i int"), "k", "ms", "i").count() == 0
    big = 2**60
    df = spark.createDataFrame([(big, 1, 1, "x"), (big + 1, 2, 1, "x"), (None, 3, 1, "x"), (big, 1, 1, "x")], "k long, ms long, i int, emitted string")
    got = sorted((r.k or 0, r.ms, r.emitted) for r in t.debounced(df, "k", "ms", "i", part_rows=1).collect())
    assert got == [(0, 3, True), (big, 1, True), (big, 1, True), (big + 1, 2, True)]
