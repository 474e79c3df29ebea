"""The streaming jobs run to the end of the driver's tables, their results read back."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapter
from ..sources.checkpoints import shared_folder
from ..streaming import deliveries
from ..streaming import listings as streams
from . import snapshots, texts
from .stand_ins import delivered, hashed, listing_rows, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # event times need a zone; the pattern takes a table of one file as well as a folder
    schema = ", ".join(f"{n} {'timestamp' if t == 'timestamp_ntz' else t}" for n, t in table(spark, sf_dir, name).dtypes)
    return streams.stream_listings(spark, f"{sf_dir}/{name}.parquet*", schema)


def _run(df: DataFrame) -> DataFrame:
    """The stream's output once all that is there has come through."""
    spark = df.sparkSession
    folder = _folder(spark)
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def read(spark, sf_dir):
    return _run(_stream(spark, sf_dir, "events")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def dedup(spark, sf_dir):
    key = ["user_id", "event_type", "props"]
    return _run(streams.stream_dedup(_stream(spark, sf_dir, "events"), key, "ts", "0 seconds")).select(*key)


def changes(spark, sf_dir):
    """Changes of each user's value, up to the watermark, which ends at the newest event."""
    out = _run(streams.stream_changes(_stream(spark, sf_dir, "events"), F.col("user_id"), "ts", "event_id", "value", "0 seconds"))
    return out.select(F.col("key").cast("long").alias("user_id"), "event_id", "previous", "value")


def silent(spark, sf_dir):
    """Users who were silent for six hours before the newest event."""
    out = _run(streams.stream_vanished(_stream(spark, sf_dir, "events"), F.col("user_id"), "ts", 6 * 3_600_000, "0 seconds"))
    return out.select(F.col("key").cast("long").alias("user_id"), "last_seen")


def upsert(spark, sf_dir):
    """A table of listings after a stream of deliveries has been merged into it."""
    folder = _folder(spark)
    current, _ = snapshots.snapshots(spark, sf_dir)
    current = current.withColumn("disappeared_at", F.lit(None).cast("timestamp"))
    schema = ", ".join(f"{n} {t}" for n, t in current.dtypes)
    current.write.partitionBy("supplier_id").parquet(f"{folder}/table")
    query = streams.stream_upsert(delivered(listing_rows(_stream(spark, sf_dir, "orders"))), f"{folder}/table", snapshots._at(), schema, f"{folder}/state")
    query.awaitTermination()
    return snapshots.shown(spark.read.schema(schema).parquet(f"{folder}/table"))


def _loads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Deliveries of all orders as listings, in four loads of mixed order, then a sign of life.

    Supplier s ends its run well, but for s % 10 = 3 (fails) and s % 10 = 7 (falls silent); every fifth supplier
    delivers again later, without products of p % 3 = 0 and dearer by 5 for p % 4 = 0.
    """
    rows = delivered(listing_rows(table(spark, sf_dir, "orders"))).where("verdict <> 'REJECTED'").drop("verdict", "fetched_at")
    s, p, hour = F.col("supplier_id"), F.col("source_product_id"), lambda h: F.to_timestamp(F.lit(f"2024-01-01 {h}:00:00"))
    dearer = F.when(p % 4 == 0, F.col("price") + 5).otherwise(F.col("price")).cast("decimal(20,6)")
    again = hashed(rows.where((s % 5 == 0) & (p % 3 != 0)).withColumn("price", dearer))
    listed = rows.withColumns({"run_id": F.lit(1), "kind": F.lit(deliveries.ROW), "at": hour("06")}).unionByName(
        again.withColumns({"run_id": F.lit(2), "kind": F.lit(deliveries.ROW), "at": hour("12")})
    )
    kind = F.when(s % 10 == 3, deliveries.FAILED).otherwise(deliveries.END)
    ends = rows.select(s).distinct().where(s % 10 != 7)
    marks = ends.select("*", F.lit(1).alias("run_id"), kind.alias("kind"), hour("07").alias("at"))
    marks = marks.unionByName(ends.where(s % 5 == 0).select("*", F.lit(2).alias("run_id"), F.lit(deliveries.END).alias("kind"), hour("13").alias("at")))
    tick = spark.range(1).select(F.lit(deliveries.TICK).alias("kind"), F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("at"))
    parts = [listed.where(p % 4 == k) for k in range(4)]
    parts[1] = parts[1].unionByName(marks, allowMissingColumns=True)  # before some of the rows
    return [*parts, tick.select(*(F.col(c) if c in tick.columns else F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in listed.columns))]


def _delivered(spark: SparkSession, sf_dir: str, times: int = 1) -> deliveries.Sink:
    """The table after all loads have arrived one by one; each batch is applied ``times`` times."""
    folder = _folder(spark)
    current, _ = snapshots.snapshots(spark, sf_dir)
    current = current.withColumn("disappeared_at", F.lit(None).cast("timestamp"))
    schema = ", ".join(f"{n} {t}" for n, t in current.dtypes)
    sink = deliveries.Sink(f"{folder}/table", schema)
    current.write.partitionBy("supplier_id").parquet(f"{sink.path}/listings")
    sink.create(spark)
    name = deliveries.stream_name(f"{folder}/state")

    def apply(batch: DataFrame, number: int) -> None:
        if times > 1:
            batch.persist(StorageLevel.DISK_ONLY)  # else a batch that releases no run goes through the state once more
        for _ in range(times):
            sink.apply(batch, number, name)
        batch.unpersist()

    for load in _loads(spark, sf_dir):
        load.write.mode("append").parquet(f"{folder}/in")
        arriving = streams.stream_listings(spark, f"{folder}/in", ", ".join(f"{n} {t}" for n, t in load.dtypes), files=10**6)
        deliveries.stream_deliveries(arriving, sink, f"{folder}/state", "at", "1 day", apply=apply).awaitTermination()
    return sink


def whole_runs(spark, sf_dir):
    """The listings after deliveries in pieces; failed and silent runs change nothing, vanished is judged run by run."""
    return snapshots.shown(_delivered(spark, sf_dir).read(spark))


def replayed_history(spark, sf_dir):
    """Price history of the same deliveries, each batch applied twice: a second time appends nothing."""
    prices = _delivered(spark, sf_dir, 2).read(spark, "prices")
    return prices.groupBy("supplier_id", "source_product_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("price", "observed_at").cast("double"), 2).alias("last"))


def _late(spark: SparkSession, sf_dir: str, counts) -> tuple[DataFrame, int]:
    """(counts over all events, dropped rows) when the events come in four loads and some of them a load or more behind."""
    folder, e = _folder(spark), table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    behind = F.when(F.col("event_id") % 17 == 0, 4).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    quarter = F.expr(f"(unix_micros(ts) - {span.low}L) * 4 div {span.high - span.low + 1}L")
    e = e.withColumn("load", F.least(F.lit(3).cast("long"), quarter + behind))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(span.high + 10**6 * 86_400 * 30)).alias("ts"))
    tick = tick.select(*tick.columns, F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("double").alias("value"))
    ran = []
    for load in (*(e.where(F.col("load") == k).drop("load") for k in range(4)), tick):
        load.write.mode("append").parquet(f"{folder}/in")
        arriving = streams.stream_listings(spark, f"{folder}/in", ", ".join(f"{n} {t}" for n, t in load.dtypes), files=10**6)
        out = streams.counted(arriving, "ts", "6 hours", counts, F.col("event_id") < 0)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        ran.append(query)
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), streams.late_rows(ran)["late"]


def late_windows(spark, sf_dir):
    """Hourly counts of events that came in time, and in a row without an hour how many did not."""
    out, late = _late(spark, sf_dir, lambda df: streams.changes_per_window(df, "ts", "1 hour"))
    rows = out.select(F.col("window_start").cast("string").alias("window_start"), "n")
    return rows.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("window_start"), F.lit(late).cast("long").alias("n")))


def late_sessions(spark, sf_dir):
    """Each user's events that came in time for a session, and in a row without a user how many did not."""
    out, late = _late(spark, sf_dir, lambda df: streams.sessions(df, "ts", "6 hours", "user_id"))
    rows = out.groupBy("user_id").agg(F.sum("n").alias("n"))
    return rows.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(late).cast("long").alias("n")))


def _late_sql(name: str, value: str, ends: str) -> str:
    """A load's watermark is the newest event of the loads before, less the delay; what ends at or before it is late."""
    return f"""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), s AS (SELECT min(us) AS low, max(us) AS high FROM e),
      b AS (SELECT e.*, least(3, (us - low) * 4 // (high - low + 1) + CASE WHEN event_id % 17 = 0 THEN 4 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS load FROM e, s),
      m AS (SELECT load, max(us) AS top FROM b GROUP BY 1),
      k AS (SELECT b.*, coalesce((SELECT max(top) FROM m WHERE m.load < b.load) // 1000 * 1000 - 6 * 3600000000, 0) AS mark FROM b),
      f AS (SELECT {value} AS {name}, {ends} <= mark AS late FROM k)
      SELECT {name}, count(*) AS n FROM f WHERE NOT late GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM f WHERE late"""


def stream_pages(spark, sf_dir):
    """Cards of each supplier when its pages are read as a stream, in two loads."""
    adapter.register(spark)
    first, folder = texts.saved_pages(spark, sf_dir), _folder(spark)
    pages = spark.read.schema("page_id long, url string, html string, supplier string").parquet(first)
    for k in range(2):
        pages.where(F.col("page_id") % 2 == k).write.mode("append").partitionBy("supplier").parquet(f"{folder}/in")
        arriving = texts.adapter_rows(spark.readStream.format(adapter.NAME).options(**texts.adapter_options(f"{folder}/in")).load())
        query = arriving.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema(arriving.schema).parquet(f"{folder}/out")
    return out.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.count("source_id").alias("n_ids"), F.count_if(F.col("missing") != "").alias("n_missing"))


# the runs that count, and the listings that each leaves
RUNS_SQL = f"""{snapshots.SNAPSHOT_SQL}, one AS (SELECT * FROM inc WHERE verdict <> 'REJECTED' AND supplier_id % 10 NOT IN (3, 7)),
two AS (SELECT supplier_id, p, CASE WHEN p % 4 = 0 THEN price + 5 ELSE price END AS price, stock_status, stock_qty FROM one WHERE supplier_id % 5 = 0 AND p % 3 <> 0)"""

QUERIES = {
    "st5_whole_runs": (
        whole_runs,
        f"""WITH {RUNS_SQL}, k AS (SELECT supplier_id, p FROM cur UNION SELECT supplier_id, p FROM one)
            SELECT k.supplier_id, k.p AS source_product_id, round(coalesce(t.price, o.price, c.price)::DOUBLE, 2) AS price,
              CASE WHEN k.supplier_id IN (SELECT supplier_id FROM one) AND (CASE WHEN k.supplier_id IN (SELECT supplier_id FROM two) THEN t.p ELSE o.p END) IS NULL THEN 'OUT_OF_STOCK'
                   ELSE coalesce(t.stock_status, o.stock_status, c.stock_status) END AS stock_status,
              coalesce(t.stock_qty, o.stock_qty, c.stock_qty) AS stock_qty,
              k.supplier_id IN (SELECT supplier_id FROM one) AND (CASE WHEN k.supplier_id IN (SELECT supplier_id FROM two) THEN t.p ELSE o.p END) IS NULL AS gone
            FROM k LEFT JOIN cur AS c USING (supplier_id, p) LEFT JOIN one AS o USING (supplier_id, p) LEFT JOIN two AS t USING (supplier_id, p)""",
    ),
    "st5_snk2_replayed_history": (
        replayed_history,
        f"""WITH {RUNS_SQL}, h AS (
              SELECT o.supplier_id, o.p, o.price, 1 AS run FROM one AS o LEFT JOIN cur AS c USING (supplier_id, p) WHERE c.p IS NULL OR c.price <> o.price
              UNION ALL SELECT t.supplier_id, t.p, t.price, 2 FROM two AS t JOIN one AS o USING (supplier_id, p) WHERE t.price <> o.price)
            SELECT supplier_id, p AS source_product_id, count(*) AS n, round(max_by(price, run)::DOUBLE, 2) AS last FROM h GROUP BY ALL""",
    ),
    "st6_late_windows": (late_windows, _late_sql("window_start", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')", "us // 3600000000 * 3600000000 + 3600000000")),
    "st6_late_sessions": (late_sessions, _late_sql("user_id", "user_id", "us + 6 * 3600000000")),
    "st1_stream_pages": (
        stream_pages,
        f"WITH {texts.ADAPTER_SQL} SELECT supplier, count(*) AS n, count(source_id) AS n_ids, count(*) FILTER (missing <> '') AS n_missing FROM both_ GROUP BY 1",
    ),
    "st1_stream_read": (read, "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1"),
    "st2_stream_dedup": (dedup, "SELECT DISTINCT user_id, event_type, props FROM events"),
    "st3_stream_changes": (
        changes,
        """SELECT user_id, event_id, previous, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
           WHERE value <> previous AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events)""",
    ),
    "st4_stream_vanished": (
        silent,
        "SELECT user_id, date_trunc('milliseconds', max(ts)) AS last_seen FROM events GROUP BY 1 HAVING epoch_ms(max(ts)) + 6 * 3600000 < (SELECT epoch_ms(max(ts)) FROM events)",
    ),
    "st5_stream_upsert": (upsert, snapshots.UPSERT_SQL),
}
