"""Diagnostic events: debounce, cache ages, counters, gaps. Batch forms, and streaming forms of the stateful ones."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewright.session import written

DEBOUNCE_MS, TTL_MS, RING, SLOW_MS = 1500, 900_000, 500, 1500
#: Distinct times of keys that one task folds at once.
PART_ROWS = 500_000


def _following(t: np.ndarray, window_ms: int) -> np.ndarray:
    """Of sorted distinct times: the place of the first one window_ms or more later; a time without one points to itself."""
    at = np.searchsorted(t, t + window_ms)
    return np.where(at < len(t), at, np.arange(len(t)))


def _summaries(window_ms: int):
    """Of one part: for each key that may go on in another, which time is emitted last, by the time emitted first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, part = [], int(pdf["_part"].iloc[0])
        for key, times in pdf[pdf["_h"].isin((pdf["_h"].min(), pdf["_h"].max()))].groupby("_k", dropna=False)["_t"]:
            t = np.sort(times.to_numpy())
            to = _following(t, window_ms)
            while (ahead := to[to]).tolist() != to.tolist():
                to = ahead
            # The first emitted time lies within a window of the part's start, or is the first one after it.
            last = t[to[: np.searchsorted(t, t[0] + window_ms) + 1]]
            ends = np.append(last[1:] != last[:-1], True)
            rows.append((None if pd.isna(key) else key, part, t[: len(last)][ends].tolist(), last[ends].tolist()))
        return pd.DataFrame(rows, columns=["_k", "_part", "firsts", "lasts"])

    return run


def _entering(window_ms: int):
    """Of one key's summaries: the last time emitted before each of its parts but the first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for r in pdf.sort_values("_part").itertuples(index=False):
            if last is not None:
                rows.append((r[0], r[1], last))
            at = 0 if last is None else int(np.searchsorted(r[2], last + window_ms))
            if at < len(r[2]):
                last = int(r[3][at])
        return pd.DataFrame(rows, columns=["_k", "_part", "last"])

    return run


def _emitted(window_ms: int):
    """Of one part, with what its keys bring along: the emitted times and their gaps."""

    def run(pdf: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        before = {None if pd.isna(k) else k: int(v) for k, v in zip(entering["_k"], entering["last"], strict=True)}
        rows = []
        for key, times in pdf.groupby("_k", dropna=False)["_t"]:
            key = None if pd.isna(key) else key
            t, last = sorted(times.tolist()), before.get(key)
            at = 0 if last is None else bisect_left(t, last + window_ms)
            while at < len(t):
                rows.append((key, t[at], 0 if last is None else t[at] - last))
                last = t[at]
                at = bisect_left(t, last + window_ms, at + 1)
        return pd.DataFrame(rows, columns=["_k", "_t", "gap_ms"])

    return run


def debounced(events: DataFrame, key: str, ts_ms: str, tie: str, window_ms: int = DEBOUNCE_MS, part_rows: int = PART_ROWS) -> DataFrame:
    """events with emitted and gap_ms: an event is emitted if its key's last emitted one is window_ms old or more.

    Suppressed events do not renew the wait. gap_ms is null for suppressed events, 0 for a key's first. Of events at one time the one
    with the smallest `tie` can be emitted; rows that repeat key, time and tie are one event. Rows without a time are suppressed,
    a null key is a key of its own, and keys are told apart by their text. window_ms must be positive.

    Each key's distinct times are dealt to ranges of about part_rows, so that a hot key is spread over many. A range folds to a step
    function, from the first time emitted in it to the last one; composing these along a key gives what each range starts from,
    and ranges are then walked side by side. A function has a step for each chain of times that stays apart, at most the times of one window.
    """
    if window_ms <= 0:
        raise ValueError("window_ms must be positive")
    found = events.withColumns({"_k": F.col(key).cast("string"), "_t": F.col(ts_ms).cast("long")})
    times = written(found.filter("_t IS NOT NULL").groupBy("_k", "_t").agg(F.min(tie).alias("_i")), "debounce-times")
    parts = max(1, -(-times.count() // part_rows))
    dealt = times.select("_k", "_t", F.xxhash64("_k").alias("_h")).repartitionByRange(parts, "_h", "_t").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "debounce-parts")
    sums = dealt.groupBy("_part").applyInPandas(_summaries(window_ms), "_k string, _part int, firsts array<long>, lasts array<long>")
    entering = sums.groupBy("_k").applyInPandas(_entering(window_ms), "_k string, _part int, last long")
    kept = dealt.groupBy("_part").cogroup(entering.groupBy("_part")).applyInPandas(_emitted(window_ms), "_k string, _t long, gap_ms long")

    def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
        return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])

    first = times.join(kept, same(times, kept, "_k", "_t")).select(times["_k"], times["_t"], "_i", "gap_ms")
    found = found.withColumn("_i", F.col(tie))
    out = found.join(first, same(found, first, "_k", "_t", "_i"), "left")
    return out.select(*[found[c] for c in events.columns if c not in ("gap_ms", "emitted")], "gap_ms", F.col("gap_ms").isNotNull().alias("emitted"))


def cache_use(requests: DataFrame, key: str, ts_ms: str, tie: str, ttl_ms: int = TTL_MS) -> DataFrame:
    """requests with reused: true while the last fetch of the key is younger than ttl_ms; a fetch is a request not served so."""
    return debounced(requests, key, ts_ms, tie, ttl_ms).withColumn("reused", ~F.col("emitted")).drop("emitted", "gap_ms")


def stage_times(emitted: DataFrame, stage: str, ts_ms: str) -> DataFrame:
    """By stage: emitted events, sum of gaps, and the last gap."""
    return emitted.filter("emitted").groupBy(stage).agg(F.count("*").alias("n"), F.sum("gap_ms").alias("total_ms"), F.max_by("gap_ms", ts_ms).alias("last_ms"))


def rollup(metrics: DataFrame, ts: str, key: str, kind: str, value: str) -> DataFrame:
    """By day and key: counters add up, gauges keep their last value."""
    day = metrics.withColumn("day", F.to_date(ts))
    return day.groupBy("day", key).agg(
        F.max(kind).alias("type"),
        F.when(F.max(kind) == "counter", F.sum(value)).otherwise(F.max_by(value, ts)).alias("value"),
    )


def request_counts(df: DataFrame, by: list[str], status: str, latency: str) -> DataFrame:
    """Requests, server errors and slow requests by group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(F.col(status) >= 500).alias("errors_5xx"), F.count_if(F.col(latency) > SLOW_MS).alias("slow")
    )


def ring(df: DataFrame, key: str, order: list[Column], size: int = RING) -> DataFrame:
    """The last `size` rows of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= size).drop("_k")


def sampled(df: DataFrame, key: str, rate: float) -> DataFrame:
    """A share of the rows, the same ones in every run, by a hash of the key."""
    return df.filter(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10_000)) < int(rate * 10_000))


def backoff(attempts: int, delay_ms: int) -> list[int]:
    """Waits before the retries: doubled each time."""
    return [delay_ms * 2**i for i in range(attempts)]


def retry_schedule(failed: DataFrame, key: str, ts_ms: str, attempts: int = 3, delay_ms: int = 800, jitter_ms: int = 400) -> DataFrame:
    """key, attempt (from 0), wait_ms, at_ms: when each failed request is tried again; waits double, and each has up to jitter_ms more, by a hash of key and attempt.

    Rows without a time have no schedule.
    """
    tries = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.struct(i.alias("attempt"), (F.lit(delay_ms) * F.pow(F.lit(2), i)).cast("long").alias("base")))
    rows = failed.filter(F.col(ts_ms).isNotNull()).select(key, ts_ms, F.explode(tries).alias("t"))
    jitter = F.pmod(F.crc32(F.encode(F.concat_ws(":", F.col(key).cast("string"), F.col("t.attempt").cast("string")), "UTF-8")), F.lit(jitter_ms + 1))
    waits = rows.select(key, ts_ms, "t.attempt", (F.col("t.base") + jitter).cast("long").alias("wait_ms"))
    order = W.partitionBy(key, ts_ms).orderBy("attempt").rowsBetween(W.unboundedPreceding, 0)
    return waits.select(key, "attempt", "wait_ms", (F.col(ts_ms) + F.sum("wait_ms").over(order)).alias("at_ms"))


def merged_stages(df: DataFrame, task: str, order: str, stages: str) -> DataFrame:
    """By task, one map of stages: of equal keys the last one's value."""
    pairs = df.select(task, order, F.explode(stages).alias("k", "v"))
    last = pairs.groupBy(task, "k").agg(F.max_by("v", order).alias("v"))
    return last.groupBy(task).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(stages))


def debounced_stream(events: DataFrame, key: str, ts_ms: str, window_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Streaming form of debounced: (key, ts_ms, gap_ms) of emitted events; state is the time of the last one, which the next gap needs however late it comes."""
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField(ts_ms, T.LongType()), T.StructField("gap_ms", T.LongType())])

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for t in sorted(int(t) for part in batches for t in part[ts_ms]):
            if last is None or t - last >= window_ms:
                rows.append((str(k[0]), t, 0 if last is None else t - last))
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=[key, ts_ms, "gap_ms"])

    kind = T.StructType([T.StructField("last", T.LongType())])
    return events.groupBy(key).applyInPandasWithState(run, out, kind, "append", GroupStateTimeout.NoTimeout)


def rollup_stream(metrics: DataFrame, ts: str, key: str, value: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Streaming sums by window and key; windows close `late` after their end."""
    return (
        metrics.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.sum(value).alias("value"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), key, "value", "n")
    )


def listeners(handlers: list) -> tuple:
    """(function for foreachBatch, errors): every handler gets each batch in order; one's failure does not stop the next."""
    errors: list[tuple[int, str, str]] = []

    def run(batch: DataFrame, epoch: int) -> None:
        for h in handlers:
            try:
                h(batch, epoch)
            except Exception as e:
                errors.append((epoch, getattr(h, "__name__", "handler"), str(e)))

    return run, errors


def captured(df: DataFrame, error: str) -> DataFrame:
    """df with code, message and retry of raw error texts; rows without an error have none."""
    e = F.coalesce(F.col(error), F.lit(""))
    code = (
        F.when(e == "", None).when(e.rlike("(?i)timed? ?out|ETIMEDOUT"), "timeout").when(e.rlike("(?i)ENOTFOUND|name or service|getaddrinfo"), "dns")
        .when(e.rlike(r"\b5\d\d\b"), "server").when(e.rlike(r"\b4\d\d\b"), "client").otherwise("other")
    )
    return df.withColumns({"code": code, "message": F.regexp_replace(e, r"\s+", " "), "retry": F.coalesce(code.isin("timeout", "server"), F.lit(False))})


def latency_class(status: Column, latency_ms: Column) -> Column:
    """error for a server error, slow beyond SLOW_MS, else ok."""
    return F.when(status >= 500, "error").when(latency_ms > SLOW_MS, "slow").otherwise("ok")
