"""Streams with state that ends: debounce by event-time timers, cache by time to live, request spans by an interval join.

The first two need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LONG = T.StructType([T.StructField("value", T.LongType())])
#: How long a key's last emitted event is remembered, and the longest request.
FORGET_MS, LIMIT_MS = 3_600_000, 300_000


class _Debounce(StatefulProcessor):
    """Per key: the times that may still be overtaken, and the last one emitted. Times are settled once the watermark has passed them."""

    def __init__(self, key: str, ts_ms: str, window_ms: int, forget_ms: int) -> None:
        self.key, self.ts_ms, self.window_ms, self.forget_ms = key, ts_ms, window_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LONG)
        self.waiting = handle.getListState("waiting", LONG)

    def _settle(self, key: tuple, watermark: int) -> list[tuple]:
        times = sorted({int(t[0]) for t in self.waiting.get()})
        last = int(self.last.get()[0]) if self.last.exists() else None
        out, open_times = [], [t for t in times if t > watermark]
        for t in times[: len(times) - len(open_times)]:
            if last is None or t - last >= self.window_ms:
                out.append((key[0], t, 0 if last is None or t - last > self.forget_ms else t - last))
                last = t
        if open_times:
            self.waiting.put([(t,) for t in open_times])
        else:
            self.waiting.clear()
        if last is not None and not open_times and last + self.forget_ms <= watermark:
            self.last.clear()
            return out
        if last is not None:
            self.last.update((last,))
        self.handle.registerTimer(open_times[0] if open_times else last + self.forget_ms)
        return out

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, self.ts_ms, "gap_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            fresh = sorted({int(t) for t in part[self.ts_ms] if t > watermark})
            if fresh:
                self.waiting.appendList([(t,) for t in fresh])
                self.handle.registerTimer(fresh[0])
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.waiting.exists() and not self.last.exists():
            yield self._rows([])
        else:
            yield self._rows(self._settle(key, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def debounced_timers(events: DataFrame, key: str, ts: str, window_ms: int, late: str = "10 minutes", forget_ms: int = FORGET_MS) -> DataFrame:
    """(key, ts_ms, gap_ms) of emitted events of a stream: as diagnostics.debounced, with state that ends.

    ts is a timestamp. Events may come `late` after others; they are settled in order of their times, once the watermark has passed them, so that the
    result is that of the batch form however batches are cut. Events that come later than that are dropped, as everywhere behind a watermark; rows without a time too.
    A null key is a key of its own. A key whose last emitted event is more than forget_ms old begins anew: its gap is 0, and its state is gone.
    forget_ms must be window_ms or more.
    """
    if not 0 < window_ms <= forget_ms:
        raise ValueError("window_ms must be positive and at most forget_ms")
    timed = events.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, ts, F.unix_millis(F.col(ts)).alias("ts_ms"))
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("ts_ms", T.LongType()), T.StructField("gap_ms", T.LongType())])
    return timed.groupBy(key).transformWithStateInPandas(_Debounce(key, "ts_ms", window_ms, forget_ms), out, "append", "EventTime")


def forgotten(gap_ms: Column, forget_ms: int = FORGET_MS) -> Column:
    """The gap of the batch form as a stream that forgets gives it."""
    return F.when(gap_ms > forget_ms, 0).otherwise(gap_ms)


class _Cache(StatefulProcessor):
    """Per key: a mark that lives for ttl_ms from the last fetch."""

    def __init__(self, key: str, tie: str, ttl_ms: int) -> None:
        self.key, self.tie, self.ttl_ms = key, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetched = handle.getValueState("fetched", LONG, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, known = [], self.fetched.exists()
        for tie in sorted(t for part in rows for t in part[self.tie]):
            out.append((key[0], tie, known))
            if not known:
                self.fetched.update((1,))
                known = True
        yield pd.DataFrame(out, columns=[self.key, self.tie, "reused"])

    def close(self) -> None:
        pass


def cached_requests(requests: DataFrame, key: str, tie: str, ttl_ms: int = 900_000) -> DataFrame:
    """(key, tie, reused) of a stream of requests: the first of a key is a fetch, and so is the first after ttl_ms of processing time.

    Requests of a batch are taken in order of `tie`. A key's state lives for ttl_ms; a hit does not renew it. For a stream that reads what there is and
    ends, set spark.sql.streaming.noDataMicroBatches.enabled to false: state with a time to live asks for further batches without end.
    """
    out = T.StructType([T.StructField(key, requests.schema[key].dataType), T.StructField(tie, requests.schema[tie].dataType), T.StructField("reused", T.BooleanType())])
    return requests.select(key, tie).groupBy(key).transformWithStateInPandas(_Cache(key, tie, ttl_ms), out, "append", "ProcessingTime")


def snapshots(records: DataFrame, tag: str, error: str | None = None) -> DataFrame:
    """Records as tagged snapshots: level (SNAP by default, ERROR where there is an error), req_id, stage, tag, data and the error's name, code and message.

    records has ts and may have level, req_id, stage and data; tag and error are columns, the latter JSON of an error.
    """
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    fail = F.col(error) if error else F.lit(None).cast("string")
    part = lambda name: F.get_json_object(fail, f"$.{name}")
    return records.select(
        "ts", F.col(tag).alias("tag"), F.when(fail.isNotNull(), "ERROR").otherwise(F.coalesce(has("level"), F.lit("SNAP"))).alias("level"), has("req_id").alias("req_id"), has("stage").alias("stage"),
        has("data").alias("data"), part("name").alias("error_name"), part("code").alias("error_code"), F.coalesce(part("message"), part("cause.message"), part("cause")).alias("error_message"),
    )


def request_spans(snaps: DataFrame, start: str = "http:req:start", end: str = "http:req:end", limit_ms: int = LIMIT_MS, late: str | None = None) -> DataFrame:
    """req_id, start_ts, end_ts, span_ms, status (done or open): each start with each end of its request that comes within limit_ms.

    snaps has ts, tag and req_id; rows without one of them take no part. A start without such an end is open, with null end_ts. late makes it a stream-stream
    join: both sides are held until the watermark, `late` behind the newest snapshot, is past limit_ms after them, and open requests are
    told then. Batch and stream give the same rows, but for snapshots later than that.
    """
    known = snaps.filter(F.col("ts").isNotNull() & F.col("req_id").isNotNull())
    starts = known.filter(F.col("tag") == start).select("req_id", F.col("ts").alias("start_ts"))
    ends = known.filter(F.col("tag") == end).select(F.col("req_id").alias("end_id"), F.col("ts").alias("end_ts"))
    if late is not None:
        starts, ends = starts.withWatermark("start_ts", late), ends.withWatermark("end_ts", late)
    bound = F.expr(f"start_ts + INTERVAL {limit_ms / 1000:.3f} SECONDS")
    met = (F.col("req_id") == F.col("end_id")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= bound)
    pairs = starts.join(ends, met, "left_outer")
    span = F.unix_millis("end_ts") - F.unix_millis("start_ts")
    return pairs.select("req_id", "start_ts", "end_ts", span.alias("span_ms"), F.when(F.col("end_ts").isNull(), "open").otherwise("done").alias("status"))
