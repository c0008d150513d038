import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tablewright.streaming import diagnostics, stateful

SF = "/root/testdata/sf0.01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = "spark.sql.streaming.stateStore.providerClass"
UTC = datetime.timezone.utc


@pytest.fixture()
def rocks(spark):
    # Every batch opens a store in every partition; two are enough here.
    new = {KEY: ROCKS, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def streamed(spark, tmp_path, batches, build, mode="append", gone=None):
    """The rows of a stream that reads one file a batch, in order, and its progress."""
    src, out = str(tmp_path / "src"), "t" + uuid.uuid4().hex
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{src}/part={i:03d}")
        for f in (tmp_path / "src" / f"part={i:03d}").glob("*.parquet"):
            import os

            os.utime(f, (1_600_000_000 + 60 * i, 1_600_000_000 + 60 * i))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = build(stream).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    if q.exception():
        raise q.exception()
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {out}").collect()], q.recentProgress


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, UTC)


def cut(spark, rows, kind, parts, end):
    size = -(-len(rows) // parts)
    batches = [spark.createDataFrame(rows[i : i + size], kind) for i in range(0, len(rows), size)]
    # A last event far ahead moves the watermark past all others.
    return [*batches, spark.createDataFrame([end], kind)]


def test_debounce_with_timers_equals_batch_and_forgets(rocks, tmp_path):
    pick, rows, ms = random.Random(4), [], 1_700_000_000_000
    for i in range(900):
        ms += pick.randint(0, 4000)
        # Keys come and go, so that a state for each for ever would grow.
        rows.append((pick.choice(["hot", None, f"k{i // 60}", f"k{i // 60}b"]), at(ms), i))
    # Out of order, within what the watermark allows.
    mixed = sorted(rows, key=lambda r: r[1].timestamp() + pick.uniform(-20, 20))
    kind, forget = "key string, ts timestamp, i int", 60_000
    stream, progress = streamed(
        rocks, tmp_path, cut(rocks, mixed, kind, 6, ("end", at(ms + 10_000_000), -1)), lambda s: stateful.debounced_timers(s, "key", "ts", 1500, "60 seconds", forget)
    )
    batch = diagnostics.debounced(rocks.createDataFrame(rows, kind).withColumn("ms", F.unix_millis("ts")), "key", "ms", "i", 1500).filter("emitted")
    want = sorted((r.key or "", r.ms, r.g) for r in batch.select("key", "ms", stateful.forgotten(F.col("gap_ms"), forget).alias("g")).collect())
    got = sorted((k or "", t, g) for k, t, g in stream if k != "end")
    assert got == want
    states = [o["numRowsTotal"] for p in progress for o in p["stateOperators"]]
    assert len({r[0] for r in rows}) > 30 and states[-1] <= 4


def test_debounce_drops_what_is_too_late(rocks, tmp_path):
    base, kind = 1_700_000_000_000, "key string, ts timestamp, i int"
    batches = [[("a", at(base), 1)], [("b", at(base + 500_000), 2)], [("b", at(base + 600_000), 3)], [("a", at(base + 1000), 4), (None, None, 5)], [("b", at(base + 9_000_000), 6)]]
    got, _ = streamed(rocks, tmp_path, [rocks.createDataFrame(b, kind) for b in batches], lambda s: stateful.debounced_timers(s, "key", "ts", 1500, "10 seconds", 3_600_000))
    assert sorted((k, t - base, g) for k, t, g in got) == [("a", 0, 0), ("b", 500_000, 0), ("b", 600_000, 100_000)]
    with pytest.raises(ValueError):
        stateful.debounced_timers(rocks.createDataFrame(batches[0], kind), "key", "ts", 5000, "1 second", 100)


@pytest.fixture()
def data_batches_only(spark):
    # State with a time to live asks for batches without data for ever, also of a stream that ends.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_cache_entries_end(rocks, data_batches_only, tmp_path):
    rows = [(k, i) for i, k in enumerate(["a", "b", "a", None, "a", None, "b"])]
    batches = [rocks.createDataFrame(rows[i : i + 2], "url string, i int") for i in range(0, 7, 2)]
    got, _ = streamed(rocks, tmp_path / "long", batches, lambda s: stateful.cached_requests(s, "url", "i", 3_600_000))
    assert sorted((i, reused) for _, i, reused in got) == [(0, False), (1, False), (2, True), (3, False), (4, True), (5, True), (6, True)]
    # Entries that live for a millisecond are gone by the next batch.
    got, progress = streamed(rocks, tmp_path / "short", batches, lambda s: stateful.cached_requests(s, "url", "i", 1))
    assert {(i, reused) for _, i, reused in got} == {(i, False) for i in range(7)}


def spans(df):
    return sorted((r[0], str(r[1]), str(r[2]), r[3], r[4]) for r in df)


def test_request_spans_of_stream_and_batch(rocks, tmp_path):
    spark = rocks
    pick, base, rows = random.Random(9), 1_700_000_000_000, []
    for i in range(300):
        start = base + 1000 * i
        rows.append((at(start), "http:req:start", f"r{i}"))
        fate = i % 5
        if fate < 3:
            rows.append((at(start + pick.randint(0, 20_000)), "http:req:end", f"r{i}"))
        if fate == 2:
            rows.append((at(start + 19_999), "http:req:end", f"r{i}"))
        if fate == 3:
            rows.append((at(start + 400_000), "http:req:end", f"r{i}"))
    rows += [(at(base + 7), "http:req:end", "nobody"), (at(base + 8), "other", "r1"), (None, "http:req:start", "x"), (at(base), "http:req:start", None), (at(base - 5), "http:req:end", "r0")]
    rows.sort(key=lambda r: (r[0] or at(base)).timestamp() + pick.uniform(-5, 5))
    kind = "ts timestamp, tag string, req_id string"
    want = spans(stateful.request_spans(spark.createDataFrame(rows, kind), limit_ms=20_000).collect())
    end = [(at(base + 9_000_000), t, "end") for t in ("http:req:start", "http:req:end")]
    batches = [*(spark.createDataFrame(rows[i : i + 120], kind) for i in range(0, len(rows), 120)), spark.createDataFrame(end, kind), spark.createDataFrame([(at(base + 9_100_000), t, "end2") for t in ("http:req:start", "http:req:end")], kind)]
    got, progress = streamed(spark, tmp_path, batches, lambda s: stateful.request_spans(s, limit_ms=20_000, late="30 seconds"))
    assert spans(r for r in got if not r[0].startswith("end")) == want
    assert {w[4] for w in want} == {"open", "done"} and len(want) > 300
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 20


def test_snapshots(spark):
    rows = [(at(0), "a", None, None, '{"x":1}'), (at(1), "b", "INFO", '{"name":"E","code":"ETIMEDOUT","message":"slow"}', None), (at(2), "c", "INFO", '{"cause":{"message":"why"}}', None)]
    df = spark.createDataFrame(rows, "ts timestamp, t string, level string, err string, data string")
    got = [(r.tag, r.level, r.req_id, r.error_name, r.error_code, r.error_message) for r in stateful.snapshots(df, "t", "err").orderBy("ts").collect()]
    assert got == [("a", "SNAP", None, None, None, None), ("b", "ERROR", None, "E", "ETIMEDOUT", "slow"), ("c", "ERROR", None, None, None, "why")]
