import os
import random

from pyspark.sql import types as T

from tablewright.streaming.upsert import Buckets, upserted

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("at", T.LongType())])


def files(path):
    return {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet") and "/log/" not in f}


def test_batches_replays_and_touched_buckets(spark, tmp_path):
    table, pick, want = Buckets(spark, str(tmp_path / "t"), SCHEMA, "k", "at", 8), random.Random(1), {}
    assert table.table().count() == 0
    for number in range(4):
        rows = [(pick.choice([None, *range(30)]), f"{number}-{i}", pick.randint(0, 9)) for i in range(25)]
        for k, v, at in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2]):
            if k not in want or want[k][1] <= at:
                want[k] = (v, at)
        df = spark.createDataFrame(rows, SCHEMA)
        table.merge(df, number)
        before = files(tmp_path)
        # A batch that comes again changes nothing.
        table.merge(df, number)
        assert files(tmp_path) == before
        got = {r.k: r.at for r in table.table().collect()}
        assert got == {k: at for k, (_, at) in want.items()} and table.table().count() == len(want)
    # One key touches one bucket; an older row does not win, an equal one of a later batch does.
    before = files(tmp_path)
    table.merge(spark.createDataFrame([(3, "new", 9), (3, "old", 1)], SCHEMA), 10)
    assert len(files(tmp_path) - before) == 1
    assert [r.v for r in table.table().filter("k = 3").collect()] == ["new"]
    table.merge(spark.createDataFrame([(3, "older", 2)], SCHEMA), 11)
    assert [r.v for r in table.table().filter("k = 3").collect()] == ["new"]


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, "k", "at", 4)
    table.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), 0)
    # Rows of batch 1 that no log names.
    spark.createDataFrame([(1, "lost", 5)], SCHEMA).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(str(tmp_path / "t" / "version=1"))
    assert {r.v for r in table.table().collect()} == {"a", "b"}
    table.merge(spark.createDataFrame([(1, "c", 2)], SCHEMA), 1)
    assert {r.v for r in table.table().collect()} == {"c", "b"}


def test_stream_is_merged(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame([(k, f"{i}", i) for k in range(i, i + 5)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, "k", "at", 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(upserted(table)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r.k: r.v for r in table.table().collect()} == {0: "0", 1: "1", 2: "2", 3: "2", 4: "2", 5: "2", 6: "2"}
