"""Queries on changing listings: differences, upserts, histories, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..operators import listings as ops
from ..sources import listings as src
from ..streaming.listings import changes_per_window, sessions
from .stand_ins import SNAPSHOT_SQL, snapshots, table

KEY = ("supplier_id", "source_product_id")
AT = "2024-01-01 00:00:00"


def _at():
    return F.to_timestamp(F.lit(AT))


def _diff(spark, sf_dir):
    return ops.diff_listings(*snapshots(spark, sf_dir))


def read_listings(spark, sf_dir):
    schema = "l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate timestamp"
    df = src.read_listings(spark, f"{sf_dir}/lineitem.parquet", schema)
    return df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("newest"))


def diff_listings(spark, sf_dir):
    return _diff(spark, sf_dir).select(*KEY, "status", "price_changed", "stock_changed")


def sync_stats(spark, sf_dir):
    return ops.sync_stats(_diff(spark, sf_dir))


def vanished(spark, sf_dir):
    current, incoming = snapshots(spark, sf_dir)
    return ops.vanished(current, incoming).select(*KEY)


def upsert(spark, sf_dir):
    current, incoming = snapshots(spark, sf_dir)
    current = current.withColumn("disappeared_at", F.lit(None).cast("timestamp"))
    return shown(ops.upsert_listings(current, incoming, _at()))


def shown(out):
    return out.select(*KEY, F.round(F.col("price").cast("double"), 2).alias("price"), "stock_status", "stock_qty", F.col("disappeared_at").isNotNull().alias("gone"))


def _history(which):
    def run(spark, sf_dir):
        df = ops.history_rows(_diff(spark, sf_dir), _at())[which]
        value = F.round(F.col("price").cast("double"), 2).alias("price") if which == 0 else F.col("stock_qty")
        return df.select(*KEY, value, F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"))

    return run


def price_moves(spark, sf_dir):
    """Changes of a part's discount over its lines in order of shipping."""
    h = table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount")
    moved = ops.price_moves(h, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], "l_discount")
    return moved.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_moves"), (F.round(F.sum(F.col("l_discount") - F.col("previous")), 4) + 0.0).alias("net"))


def hot_price_moves(spark, sf_dir):
    """Changes of the discount along all lines of even parts as one key, and of each other part."""
    h = table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount")
    h = h.withColumn("key", F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(F.col("l_partkey")))
    moved = ops.price_moves(h, "key", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], "l_discount", spread=True)
    return moved.groupBy("key").agg(F.count(F.lit(1)).alias("n_moves"), (F.round(F.sum(F.abs(F.col("l_discount") - F.col("previous"))), 4)).alias("moved"))


def recent_history(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return ops.recent_history(h, "l_partkey", order, 20).select("l_partkey", "l_orderkey", "l_linenumber", "recency")


def content_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", ops.content_hash(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content_hash"))


def latest_policy(spark, sf_dir):
    """The newest event of each user and type, as a cache keeps its newest payload."""
    e = table(spark, sf_dir, "events")
    return ops.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "props")


def policy_cache(spark, sf_dir):
    """A cache of policies, from events before the eighth day, after what was fetched later: the newest of each user and type."""
    from ..sources.metadata import upsert_policy_cache

    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("marketplace"), F.col("user_id").alias("category_id"), F.lit("SANDBOX").alias("environment"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("payload")
    )
    split = F.to_timestamp(F.lit("2024-01-08"))
    return upsert_policy_cache(e.where(F.col("fetched_at") < split), e.where(F.col("fetched_at") >= split)).select("marketplace", "category_id", "payload")


def attribute_gate(spark, sf_dir):
    """Parts' attributes with provenance: what breaks the rules on sources, values and confidences, and repeated fields."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    df = p.select(
        k.alias("id"), (k % 50).alias("listing_id"), F.concat(F.lit("f"), F.col("p_size")).alias("field"), F.when(k % 7 != 0, F.col("p_name")).alias("value"),
        F.when(k % 10 == 0, "unknown").otherwise("manual").alias("source"), (k % 13 / 10).alias("confidence"), (k % 4 == 0).alias("current"),
    )
    _, bad = ops.quality_gate(df, ops.attribute_rules(), {"one_value_for_each_field": (["listing_id", "field"], F.col("current"))})
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


def market_gate(spark, sf_dir):
    """Orders as published listings with their images, matches and observations: what breaks the rules, and live twins."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    of = lambda n, c: F.when(k % n != 0, c)
    df = o.select(
        k.alias("listing_id"), (F.col("o_custkey") % 40).alias("product_id"), (k % 9 - 1).alias("quantity"), F.when(k % 2 == 0, "PUBLISHED").otherwise("DRAFT").alias("status"),
        of(5, F.col("o_totalprice")).alias("price"), of(11, F.lit("USD")).alias("currency"), of(12, F.repeat(F.lit("t"), (k % 90).cast("int"))).alias("title"), (k % 6 == 0).alias("redacted"), (k % 4 == 0).alias("approved"),
        of(8, F.col("o_orderdate")).alias("approved_at"), of(3, k % 21 / 15).alias("score"), of(7, k % 5).alias("active_min"), of(13, k % 7).alias("active_max"), F.when(k % 31 == 0, " ").otherwise("n").alias("name_en"),
        F.lit("n").alias("name_key"), (k % 16 == 0).alias("verified"), of(32, F.lit("me")).alias("verified_by"), of(9, k % 23 / 20).alias("processing_confidence"),
    )
    live = (F.col("status") == "PUBLISHED") & (F.col("listing_id") % 100 == 0)
    _, bad = ops.quality_gate(df, [*ops.market_rules(), *ops.processing_rules()], {"one_live_listing": (["product_id"], live)})
    return bad.select("listing_id", F.array_join("reasons", ",").alias("reasons"))


def quality_gate(spark, sf_dir):
    """Suppliers' and customers' accounts as listings: negative prices, odd stock, keys that occur twice."""
    c = table(spark, sf_dir, "customer")
    df = c.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("price"), (F.col("c_custkey") % 12 - 1).alias("stock_qty"),
                  (F.col("c_custkey") % 103 / 100).alias("confidence"), (F.col("c_custkey") % 400).alias("lock_key"), (F.col("c_custkey") % 5 == 0).alias("active"))
    rules = [*ops.listing_rules(), Rule("nation_known", F.col("c_nationkey").isNotNull())]
    _, bad = ops.quality_gate(df, rules, {"one_active_job": (["lock_key"], F.col("active"))})
    return bad.select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


def duplicate_live(spark, sf_dir):
    from ..operators.publishing import duplicate_live as find

    o = table(spark, sf_dir, "orders")
    live = o.select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("product_id"), F.col("o_orderstatus").alias("marketplace"),
                    F.lit("SANDBOX").alias("environment"), (F.col("o_orderkey") % 3 == 0).alias("is_live"))
    return find(live).select("listing_id", "n_live")


def windows(spark, sf_dir):
    df = changes_per_window(table(spark, sf_dir, "events"), "ts", "1 day", by=("event_type",))
    return df.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding(spark, sf_dir):
    df = changes_per_window(table(spark, sf_dir, "events"), "ts", "2 days", "1 day")
    return df.select(F.col("window_start").cast("string").alias("window_start"), "n", F.round("total", 2).alias("total"))


def session_counts(spark, sf_dir):
    df = sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def event_dedup(spark, sf_dir):
    """The batch twin of the stream's de-duplication: one row per user, type and payload."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"))


def event_changes(spark, sf_dir):
    """The batch twin of the change stream: events of a user whose type's value differs from the one before."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "value")
    return ops.price_moves(e, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "previous", "value")


def event_silence(spark, sf_dir):
    """Users who were silent for two days or more before the table's last event."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    end = table(spark, sf_dir, "events").agg(F.max("ts").alias("end"))
    return last.crossJoin(F.broadcast(end)).where(F.col("last_seen") < F.col("end") - F.expr("interval 2 days")).select("user_id", "last_seen")


UPSERT_SQL = f"""WITH {SNAPSHOT_SQL} SELECT coalesce(i.supplier_id, c.supplier_id) AS supplier_id, coalesce(i.p, c.p) AS source_product_id, round(coalesce(i.price, c.price)::DOUBLE, 2) AS price,
CASE WHEN seen.p IS NULL AND c.supplier_id IN (SELECT supplier_id FROM inc) THEN 'OUT_OF_STOCK' ELSE coalesce(i.stock_status, c.stock_status) END AS stock_status,
coalesce(i.stock_qty, c.stock_qty) AS stock_qty, seen.p IS NULL AND c.supplier_id IN (SELECT supplier_id FROM inc) AS gone
FROM cur AS c FULL OUTER JOIN (SELECT * FROM inc WHERE verdict <> 'REJECTED') AS i ON c.p = i.p AND c.supplier_id = i.supplier_id
LEFT JOIN inc AS seen ON seen.p = coalesce(i.p, c.p)"""
QUERIES = {
    "src1_read_listings": (read_listings, "SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS newest FROM lineitem GROUP BY 1"),
    "j11_diff_listings": (diff_listings, f"WITH {SNAPSHOT_SQL} SELECT supplier_id, p AS source_product_id, status, price_changed, stock_changed FROM diff"),
    "a8_sync_stats": (
        sync_stats,
        f"""WITH {SNAPSHOT_SQL} SELECT supplier_id, count(*) FILTER (status <> 'unseen') AS seen, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS updated,
            count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'unseen') AS unseen, count(*) FILTER (status = 'skipped') AS skipped,
            count(*) FILTER (verdict = 'CONFIRMED') AS confirmed, count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'REJECTED') AS rejected,
            count(*) FILTER (price_changed OR status = 'created') AS price_changes, count(*) FILTER (stock_changed OR status = 'created') AS stock_changes
            FROM diff GROUP BY 1""",
    ),
    "j12_set1_vanished": (
        vanished,
        f"WITH {SNAPSHOT_SQL} SELECT supplier_id, p AS source_product_id FROM cur WHERE supplier_id IN (SELECT supplier_id FROM inc) AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.p = cur.p AND inc.supplier_id = cur.supplier_id)",
    ),
    "snk1_upsert_listings": (upsert, UPSERT_SQL),
    "snk2_price_history": (
        _history(0),
        f"WITH {SNAPSHOT_SQL} SELECT supplier_id, p AS source_product_id, round(price::DOUBLE, 2) AS price, '2024-01-01' AS obs_date FROM diff WHERE status = 'created' OR price_changed",
    ),
    "snk2_stock_history": (
        _history(1),
        f"WITH {SNAPSHOT_SQL} SELECT supplier_id, p AS source_product_id, stock_qty, '2024-01-01' AS obs_date FROM diff WHERE status = 'created' OR stock_changed",
    ),
    "w5_price_moves": (
        price_moves,
        """WITH h AS (SELECT l_partkey, l_discount, lag(l_discount) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS previous FROM lineitem)
           SELECT l_partkey, count(*) AS n_moves, round(sum(l_discount - previous), 4) + 0.0::DOUBLE AS net FROM h WHERE l_discount <> previous GROUP BY 1""",
    ),
    "w5_hot_price_moves": (
        hot_price_moves,
        """WITH h AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey END AS key, l_discount,
             lag(l_discount) OVER (PARTITION BY CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey END ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS previous FROM lineitem)
           SELECT key, count(*) AS n_moves, round(sum(abs(l_discount - previous)), 4) AS moved FROM h WHERE l_discount <> previous GROUP BY 1""",
    ),
    "w4_recent_history": (
        recent_history,
        """SELECT l_partkey, l_orderkey, l_linenumber, n AS recency FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n <= 20""",
    ),
    "t14_content_hashes": (content_hashes, "SELECT o_orderkey, sha256(o_orderkey || chr(1) || o_orderstatus || chr(1) || o_orderpriority)[1:32] AS content_hash FROM orders"),
    "snk3_latest_payload": (
        latest_policy,
        "SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    ),
    "snk3_policy_cache": (
        policy_cache,
        "SELECT event_type AS marketplace, user_id AS category_id, event_id AS payload FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "dq1_attribute_rules": (
        attribute_gate,
        """WITH d AS (SELECT p_partkey AS id, p_partkey % 50 AS l, p_size AS f, p_partkey % 7 <> 0 AS has, p_partkey % 10 = 0 AS unknown, p_partkey % 13 / 10 AS c, p_partkey % 4 = 0 AS current FROM part),
           t AS (SELECT l, f FROM d WHERE current GROUP BY ALL HAVING count(*) > 1),
           r AS (SELECT id, array_to_string(list_filter([CASE WHEN c > 1 THEN 'confidence_in_range' END, CASE WHEN unknown AND has THEN 'unknown_has_no_value' END, CASE WHEN NOT has AND c <> 0 THEN 'no_value_no_confidence' END,
             CASE WHEN current AND (l, f) IN (SELECT (l, f) FROM t) THEN 'one_value_for_each_field' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d)
           SELECT id, reasons FROM r WHERE reasons <> ''""",
    ),
    "dq1_market_rules": (
        market_gate,
        """WITH d AS (SELECT o_orderkey AS k, o_custkey % 40 AS p FROM orders), t AS (SELECT p FROM d WHERE k % 100 = 0 GROUP BY 1 HAVING count(*) > 1),
           r AS (SELECT k AS listing_id, array_to_string(list_filter([CASE WHEN k % 9 = 0 THEN 'quantity_not_negative' END, CASE WHEN k % 2 = 0 AND (k % 5 = 0 OR k % 11 = 0 OR k % 12 = 0) THEN 'published_is_complete' END,
             CASE WHEN k % 12 <> 0 AND k % 90 > 80 THEN 'title_fits' END, CASE WHEN k % 12 = 0 AND k % 8 = 0 THEN 'redaction_approved_by_human' END, CASE WHEN k % 3 <> 0 AND k % 21 > 15 THEN 'score_in_range' END,
             CASE WHEN k % 7 <> 0 AND k % 13 <> 0 AND k % 7 < k % 5 THEN 'max_not_below_min' END, CASE WHEN k % 31 = 0 THEN 'name_not_blank' END, CASE WHEN k % 32 = 0 THEN 'verified_has_author' END,
             CASE WHEN k % 9 <> 0 AND k % 23 > 20 THEN 'processing_confidence_in_range' END, CASE WHEN k % 100 = 0 AND p IN (SELECT p FROM t) THEN 'one_live_listing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d)
           SELECT listing_id, reasons FROM r WHERE reasons <> ''""",
    ),
    "dq1_quality_gate": (
        quality_gate,
        """WITH d AS (SELECT c_custkey, c_nationkey, c_acctbal AS price, c_custkey % 12 - 1 AS stock_qty, c_custkey % 103 / 100 AS confidence, c_custkey % 400 AS lock_key, c_custkey % 5 = 0 AS active FROM customer),
           t AS (SELECT lock_key FROM d WHERE active GROUP BY 1 HAVING count(*) > 1),
           r AS (SELECT c_custkey, list_filter([CASE WHEN price < 0 THEN 'price_not_negative' END, CASE WHEN stock_qty < 0 THEN 'stock_not_negative' END, CASE WHEN confidence > 1 THEN 'confidence_in_range' END,
             CASE WHEN c_nationkey IS NULL THEN 'nation_known' END, CASE WHEN active AND lock_key IN (SELECT lock_key FROM t) THEN 'one_active_job' END], lambda x: x IS NOT NULL) AS reasons FROM d)
           SELECT c_custkey, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""",
    ),
    "a19_duplicate_live": (
        duplicate_live,
        "SELECT o_orderkey AS listing_id, n AS n_live FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders WHERE o_orderkey % 3 = 0) WHERE n > 1",
    ),
    "st6_tumbling_windows": (
        windows,
        "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "st6_sliding_windows": (
        sliding,
        """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 2) AS total
           FROM (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1""",
    ),
    "st6_sessions": (
        session_counts,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
           s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
           SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
    ),
    "st2_event_dedup": (event_dedup, "SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3"),
    "st3_event_changes": (
        event_changes,
        "SELECT user_id, event_id, previous, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value <> previous",
    ),
    "st4_event_silence": (
        event_silence,
        "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAYS",
    ),
}
