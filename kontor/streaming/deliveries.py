"""Deliveries of suppliers as streams: a run counts once it is whole, and each batch of runs is applied once.

A supplier's run comes in any number of files and micro-batches.  Its rows wait in keyed state until the run's end
marker has come and the watermark has passed it; then the whole run leaves in one micro-batch.  A run that its
supplier calls failed, or that falls silent without a marker, leaves nothing, so nothing of it is stored and nothing is
taken as vanished.

``Sink`` merges released runs into a table and appends their histories.  A ledger beside the data says how far each
batch of each stream has come: a batch that runs again, after a crash or by a restart, is published from what was staged
for it, or is passed over if that is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.listings import KEY, diff_listings, history_rows, upsert_listings

SUPPLIER, PRODUCT = KEY
#: Kinds of rows: a listing, the end of a run, a failed run, and a sign of life that only moves the watermark.
ROW, END, FAILED, TICK = "row", "end", "failed", "tick"
SHARDS = 16
#: Rows of a frame that are held as one element of state, a line each (JSON has no line breaks of its own); the rows of a frame that leaves.
LINES, FRAME = 1_000, 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Suppliers of a batch that are named in a partition filter; more are joined.
NAMED = 10_000


class Gather(StatefulProcessor):
    """Rows of one shard of a run, until its end."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row string")
        self.run = handle.getValueState("run", "ended long, failed boolean, last long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended, failed, last, timer = self.run.get() if self.run.exists() else (None, False, 0, None)
        for frame in rows:
            times = frame["at_ms"].astype("int64")
            last = max(last, int(times.max()))
            ends = times[frame["kind"] == END]
            if len(ends):
                ended = max(ended or 0, int(ends.max()))
            failed = failed or bool((frame["kind"] == FAILED).any())
            own = frame["row"][frame["kind"] == ROW]
            if len(own) and not failed:
                lines = own.tolist()
                self.rows.appendList([("\n".join(lines[k : k + LINES]),) for k in range(0, len(lines), LINES)])
        if failed and self.rows.exists():
            self.rows.clear()
        due = ended if ended is not None and not failed else last + self.patience
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.run.update((ended, failed, last, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended, failed, _, _ = self.run.get()
        if ended is not None and not failed and self.rows.exists():
            waiting = []
            for (lines,) in self.rows.get():
                waiting.append(lines)
                if len(waiting) * LINES == FRAME:
                    yield self._frame(key, ended, waiting)
                    waiting = []
            if waiting:
                yield self._frame(key, ended, waiting)
        self.rows.clear()
        self.run.clear()

    def close(self) -> None:
        pass

    def _frame(self, key, ended: int, rows: list[str]) -> pd.DataFrame:
        return pd.DataFrame({SUPPLIER: key[0], "run_id": key[1], "ended_ms": ended, "row": rows})


def whole_deliveries(df: DataFrame, at: str, delay: str, patience_ms: int = 86_400_000, shards: int = SHARDS) -> DataFrame:
    """Rows of runs that are complete: supplier_id, run_id, ended, and the listing's columns.

    ``df`` is a stream of supplier_id, run_id, kind, the event time ``at``, and a listing's columns (null for other kinds).
    The state is dealt by supplier, run and a shard of the products, so a supplier with a large share of the rows is
    spread over tasks; markers go to all shards, and all shards of a run are released by the same watermark.
    """
    listing = StructType([f for f in df.schema if f.name not in (SUPPLIER, "run_id", "kind", at)])
    packed = F.to_json(F.struct(*listing.names), JSON)
    own = F.array(F.pmod(F.xxhash64(PRODUCT), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    # a filter that reads the event time stays above the watermark, so signs of life move it
    rows = df.withWatermark(at, delay).where(F.when(F.col("kind") != TICK, F.col(at)).isNotNull())
    rows = rows.select(
        SUPPLIER, "run_id", F.explode(F.when(F.col("kind") == ROW, own).otherwise(every)).alias("shard"), "kind",
        F.unix_millis(at).alias("at_ms"), F.when(F.col("kind") == ROW, packed).alias("row"), at,
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = rows.groupBy(SUPPLIER, "run_id", "shard").transformWithStateInPandas(
        Gather(patience_ms), f"{SUPPLIER} {types[SUPPLIER]}, run_id {types['run_id']}, ended_ms long, row string", "append", "eventTime"
    )
    out = out.withColumn("row", F.explode(F.split("row", "\n")))
    listed = F.from_json("row", listing, JSON)
    return out.select(SUPPLIER, "run_id", F.timestamp_millis("ended_ms").alias("ended"), listed.alias("r")).select(SUPPLIER, "run_id", "ended", "r.*")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Sink:
    """A table of listings with its histories and its ledger, under one path.

    ``listings`` is partitioned by supplier: a batch reads and rewrites the suppliers of its runs, no others.  Histories
    are partitioned by stream and batch, so writing a batch's rows again replaces them.  ``schema`` is that of the
    listings (it has supplier_id, source_product_id, content_hash, price, stock_status, stock_qty, disappeared_at).
    """

    path: str
    schema: str

    def create(self, spark: SparkSession) -> None:
        """Empty tables where there are none."""
        for name, schema, by in self._tables():
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{self.path}/{name}")

    def _tables(self) -> list[tuple[str, str, list[str]]]:
        key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(self.schema) if f.name in KEY)
        stamp = "observed_at timestamp, obs_date date, stream string, batch long"
        return [
            ("listings", self.schema, [SUPPLIER]),
            ("prices", f"{key}, price decimal(20,6), {stamp}", ["stream", "batch"]),
            ("stocks", f"{key}, stock_status string, stock_qty int, {stamp}", ["stream", "batch"]),
            ("ledger", "at timestamp, stream string, batch long, step string", ["stream", "batch", "step"]),
        ]

    def read(self, spark: SparkSession, name: str = "listings") -> DataFrame:
        schema = next(s for n, s, _ in self._tables() if n == name)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def steps(self, spark: SparkSession, stream: str, number: int) -> set[str]:
        """How far a batch has come: staged, applied."""
        own = self.read(spark, "ledger").where((F.col("stream") == stream) & (F.col("batch") == number))
        return {r.step for r in own.select("step").collect()}

    def _note(self, spark: SparkSession, stream: str, number: int, step: str) -> None:
        row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"), F.lit(step).alias("step"))
        self._replace(row, "ledger")

    def _replace(self, df: DataFrame, name: str) -> None:
        """Writes the partitions that ``df`` has, in place of what they held."""
        by = next(b for n, _, b in self._tables() if n == name)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def apply(self, batch: DataFrame, number: int, stream: str) -> None:
        """Merge the runs of a micro-batch of ``whole_deliveries``; again and again gives what once gives."""
        spark, staged = batch.sparkSession, f"{self.path}/staged/{stream}-{number}"
        done = self.steps(spark, stream, number)
        if "applied" in done:
            return
        if "staged" not in done:
            if not self.stage(batch, staged):
                _delete(spark, staged)  # no run was released
                return
            self._note(spark, stream, number, "staged")
        self.publish(spark, staged, stream, number)
        self._note(spark, stream, number, "applied")
        _delete(spark, staged)

    def stage(self, batch: DataFrame, staged: str) -> bool:
        """What the batch's runs make of the table, run after run of a supplier, beside the table; False if it has no run."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{staged}/rows")
        rows = spark.read.schema(batch.schema).parquet(f"{staged}/rows")
        if rows.isEmpty():
            return False
        runs = rows.groupBy(SUPPLIER, "run_id").agg(F.max("ended").alias("ended"))
        runs = runs.withColumn("turn", F.row_number().over(Window.partitionBy(SUPPLIER).orderBy("ended", "run_id")))
        runs.write.mode("overwrite").parquet(f"{staged}/runs")
        runs = spark.read.parquet(f"{staged}/runs")
        turns = runs.agg(F.max("turn")).first()[0] or 0
        before = self._of(spark, runs)
        for turn in range(1, turns + 1):
            now = F.broadcast(runs.where(F.col("turn") == turn).select(SUPPLIER, "run_id", F.col("ended").alias("_ended")))  # a row for each supplier
            incoming = rows.join(now, [SUPPLIER, "run_id"]).drop("run_id", "ended", "_ended")
            when = now.select(SUPPLIER, "_ended")
            diff = diff_listings(before.join(when, SUPPLIER, "left_semi"), incoming).join(when, SUPPLIER)
            changes = diff.where((F.col("status") == "created") | F.col("price_changed") | F.col("stock_changed"))
            changes.write.mode("overwrite").parquet(f"{staged}/changes/turn={turn}")  # once, for both histories
            after = upsert_listings(before.join(when, SUPPLIER, "left"), incoming, F.col("_ended")).drop("_ended")
            after.write.mode("overwrite").parquet(f"{staged}/listings/turn={turn}")
            before = spark.read.schema(self.schema).parquet(f"{staged}/listings/turn={turn}")
        return True

    def _of(self, spark: SparkSession, runs: DataFrame) -> DataFrame:
        """The listings of the suppliers in ``runs``, their partitions alone."""
        suppliers = [r[0] for r in runs.select(SUPPLIER).distinct().limit(NAMED + 1).collect()]
        table = self.read(spark)
        if len(suppliers) <= NAMED:
            return table.where(F.col(SUPPLIER).isin(suppliers))
        return table.join(runs.select(SUPPLIER).distinct(), SUPPLIER, "left_semi")

    def publish(self, spark: SparkSession, staged: str, stream: str, number: int) -> None:
        """Put the staged rows in their places; what is there already is replaced by the same."""
        turns = spark.read.parquet(f"{staged}/runs").agg(F.max("turn")).first()[0]
        self._replace(spark.read.schema(self.schema).parquet(f"{staged}/listings/turn={turns}"), "listings")
        changes = spark.read.parquet(*(f"{staged}/changes/turn={t}" for t in range(1, turns + 1)))
        for name, rows in zip(("prices", "stocks"), history_rows(changes, F.col("_ended")), strict=True):
            self._replace(rows.withColumns({"stream": F.lit(stream), "batch": F.lit(number).cast("long")}), name)


def stream_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint: a new one begins its batch numbers anew."""
    return "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stream_deliveries(
    df: DataFrame, sink: Sink, checkpoint: str, at: str, delay: str, patience_ms: int = 86_400_000, shards: int = SHARDS,
    apply: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Runs a stream of deliveries (see ``whole_deliveries``) into ``sink``, to the end of what is there."""
    spark, name = df.sparkSession, stream_name(checkpoint)
    sink.create(spark)
    own = apply or (lambda batch, number: sink.apply(batch, number, name))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the state has lists and timers
    try:
        out = whole_deliveries(df, at, delay, patience_ms, shards)
        return out.writeStream.foreachBatch(own).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


