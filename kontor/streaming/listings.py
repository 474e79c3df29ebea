"""Streams of listings: reading, de-duplication, change events, vanished listings, upserts, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.listings import KEY, upsert_listings


def stream_listings(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def stream_dedup(df: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """One row per key (with the content hash in it) within the delay."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


CHANGES = "key string, at timestamp, event_id long, previous double, value double"
WAITING = "keys array<string>, at array<long>, ids array<long>, vs array<double>, known array<string>, lasts array<double>"
#: Groups that the keys of ``stream_changes`` are dealt into; the Python calls of a batch are as many at most, however many keys there are.
KEY_SHARDS = 1024


def stream_changes(df: DataFrame, key: Column, at: str, event_id: str, value: str, delay: str, shards: int = KEY_SHARDS) -> DataFrame:
    """Events at which a key's value differs from the one before, in event-time order even if rows come late.

    Rows wait in the state until the watermark has passed them, then leave in order; the state is what is still waiting
    and the last value of each key.  A row behind the watermark is dropped, as everywhere in Structured Streaming.
    Keys are dealt into ``shards`` groups, each worked out as arrays: a call for each key costs more than its rows.
    """
    rows = df.withWatermark(at, delay).select(
        F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int").alias("shard"),
        key.cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("us"), F.col(event_id).cast("long").alias("event_id"), F.col(value).cast("double").alias("value"),
    )

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, at, ids, values, known, lasts = state.get if state.exists else ([], [], [], [], [], [])
        frames = list(frames)
        keys = np.concatenate([np.array(known, dtype=object), np.array(keys, dtype=object), *(f["key"].to_numpy(dtype=object) for f in frames)])
        at = np.concatenate([np.array(at, dtype="int64"), *(f["us"].to_numpy(dtype="int64") for f in frames)])
        ids = np.concatenate([np.array(ids, dtype="int64"), *(f["event_id"].to_numpy(dtype="int64") for f in frames)])
        values = np.concatenate([np.array(values, dtype="float64"), *(f["value"].to_numpy(dtype="float64") for f in frames)])
        codes, names = pd.factorize(keys, use_na_sentinel=False)  # known keys are distinct and first: their codes are their places
        names[pd.isna(names)] = None  # the null key, which factorize calls nan
        last, seen = np.full(len(names), np.nan), np.zeros(len(names), dtype=bool)
        last[: len(known)], seen[: len(known)] = lasts, True
        codes = codes[len(known) :]
        mark = state.getCurrentWatermarkMs()
        ready = at // 1000 < mark
        order = np.flatnonzero(ready)
        order = order[np.lexsort((values[order], ids[order], at[order], codes[order]))]
        c, v = codes[order], values[order]
        edge = c[1:] != c[:-1]
        first, end = np.append(True, edge)[: len(c)], np.append(edge, True)[: len(c)]
        previous = np.append(np.nan, v[:-1])[: len(c)]
        previous[first] = last[c[first]]
        changed = (~first | seen[c]) & (v != previous)
        last[c[end]], seen[c[end]] = v[end], True
        wait = ~ready
        state.update((names[codes[wait]].tolist(), at[wait].tolist(), ids[wait].tolist(), values[wait].tolist(), names[seen].tolist(), last[seen].tolist()))
        if wait.any():
            state.setTimeoutTimestamp(max(int(at[wait].min()) // 1000 + 1, mark + 1))
        if changed.any():
            out = order[changed]
            yield pd.DataFrame({"key": names[codes[out]], "at": pd.to_datetime(at[out], unit="us"), "event_id": ids[out], "previous": previous[changed], "value": values[out]})

    return rows.groupBy("shard").applyInPandasWithState(
        step, CHANGES, WAITING, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_vanished(df: DataFrame, key: Column, at: str, silence_ms: int, delay: str) -> DataFrame:
    """Keys that were not seen for ``silence_ms`` of event time, once for each silence: key, last_seen."""
    rows = df.withWatermark(at, delay).select(key.cast("string").alias("key"), F.col(at).alias("at"))

    def step(name, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((name[0], pd.Timestamp(last, unit="ms")))
            state.remove()
        else:
            last = state.get[0] if state.exists else 0
            for f in frames:
                last = max(last, int(f["at"].astype("datetime64[ms]").astype("int64").max()))
            state.update((last,))
            state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "last_seen"])

    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_upsert(df: DataFrame, path: str, at: Column, schema: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table at ``path``, partitioned by supplier: a batch reads and rewrites the suppliers that it delivers, no others.

    Each micro-batch is taken as a whole delivery, which holds where a supplier's run is one file.  Where a run comes in
    several, use ``deliveries.stream_deliveries``, which waits for its end and keeps histories.

    The new rows are staged under ``path`` + "_staged" first, as a table cannot be overwritten while it is read; a
    batch that runs again finds its own result and writes the same.
    """
    by = KEY[0]
    spark = df.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(by).parquet(path)

    def apply(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{path}_staged/{number}"
        before = spark.read.schema(schema).parquet(path).join(batch.select(by).distinct(), by, "left_semi")
        after = upsert_listings(before, batch, at)
        after.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(after.schema).parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_per_window(df: DataFrame, at: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows; the same code for tables and streams."""
    df = df.withWatermark(at, delay) if delay else df
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


#: Names of the counts that a stream carries through ``counted``.
ARRIVED, KEPT = "arrived", "kept"


def counted(df: DataFrame, at: str, delay: str, counts: Callable[[DataFrame], DataFrame], tick: Column | None = None) -> DataFrame:
    """``counts`` (windows or sessions with a column ``n``) of a stream, with what arrived and what was kept observed on the way.

    Spark drops rows whose window has closed and its metric counts groups, not rows; the two observations tell the rows
    (``late_rows``).  ``tick`` names rows that only move the watermark; they are not counted.
    """
    df = df.withWatermark(at, delay)
    if tick is not None:
        df = df.where(F.when(~tick, F.col(at)).isNotNull())  # it reads the event time, so it stays above the watermark
    return counts(df.observe(ARRIVED, F.count(F.lit(1)).alias("n"))).observe(KEPT, F.sum("n").alias("n"))


def late_rows(queries: Iterable[StreamingQuery]) -> dict[str, int]:
    """arrived, kept and late rows of the runs of one stream; rows of windows that are still open are among the late ones
    until these close, so ask when a stream has ended or take the difference between two watermarks."""
    total = {ARRIVED: 0, KEPT: 0}
    for query in queries:
        progress = query.recentProgress
        if progress and progress[-1].batchId - progress[0].batchId + 1 > len({p.batchId for p in progress}):
            raise ValueError("progress of some batches is no longer held; raise spark.sql.streaming.numRecentProgressUpdates")
        for p in progress:
            for name in total:
                row = p.observedMetrics.get(name)
                total[name] += (row.n or 0) if row is not None else 0
    return total | {"late": total[ARRIVED] - total[KEPT]}


def sessions(df: DataFrame, at: str, gap: str, by: str, delay: str | None = None) -> DataFrame:
    """Bursts of events of one key with no gap as long as ``gap``."""
    df = df.withWatermark(at, delay) if delay else df
    out = df.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")
