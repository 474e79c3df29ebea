"""Screen queries: predicates, joins, counts and ordered lists over the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import publishing
from ..operators import reports as ops
from ..operators.substrings import NameIndex
from ..sources.checkpoints import shared_folder
from .stand_ins import table


def _d(c):
    return F.col(c).desc()


def dashboard(spark, sf_dir):
    o, line, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    c = F.col
    return ops.one_row(
        ops.counts(o, n_orders=F.lit(True), n_open=c("o_orderstatus") == "O", n_done=c("o_orderstatus") == "F", n_pending=c("o_orderstatus") == "P", n_urgent=c("o_orderpriority").startswith("1")),
        ops.counts(line, n_lines=F.lit(True), n_returned=c("l_returnflag") == "R", n_accepted=c("l_returnflag") == "A", n_discounted=c("l_discount") > 0),
        ops.counts(part, n_parts=F.lit(True), n_small=c("p_size") < 10, n_economy=c("p_type") == "ECONOMY"),
    )


def name_counts(spark, sf_dir):
    return ops.counts(table(spark, sf_dir, "part"), total=F.lit(True), verified=F.col("p_size") >= 25)


def per_supplier(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    live = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").where("l_returnflag = 'N'").withColumnRenamed("l_suppkey", "s_suppkey")
    return ops.per_key_count(s, live, "s_suppkey", "n_live")


def per_part(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey")
    lines = table(spark, sf_dir, "lineitem", "l_partkey").withColumnRenamed("l_partkey", "p_partkey")
    return ops.per_key_count(p, lines, "p_partkey", "n_images")


def verdicts(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "verdict")
    return ops.filter_by_verdict(df, "P").select("o_orderkey")


def search(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", F.col("p_name").alias("name_ja"), F.col("p_brand").alias("name_en"))
    return ops.search_names(df, "%RED%").select("p_partkey")


def indexed_search(spark, sf_dir):
    """Parts whose name or brand holds a part of a word, by the index; a short pattern is a scan."""
    df = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", F.col("p_name").alias("name_ja"), F.col("p_brand").alias("name_en"))
    index = NameIndex(f"{shared_folder(spark)}/names-{uuid.uuid4().hex}", "p_partkey")
    index.build(df)
    out = None
    for pattern in PATTERNS:
        found = index.search(df, pattern).select(F.lit(pattern).alias("pattern"), "p_partkey")
        out = found if out is None else out.unionByName(found)
    return out


#: With triples, with a wildcard between, of capitals, of a brand, of nothing there, and too short for a triple.
PATTERNS = ("%ed wid%", "%re%get%", "%GREEN%", "%and#1%", "%zzzq%", "%bl%")


def live_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ops.live(df.withColumn("resolved_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))), "resolved_at").select("o_orderkey")


def recent_members(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type").where(F.col("event_type").isin("click", "error"))
    return ops.recent(e, "ts", F.to_timestamp(F.lit("2024-01-05"))).select("event_id")


def supplier_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("l_quantity").alias("quantity"))


def product_screen(spark, sf_dir):
    """Orders as listings with their customer as supplier, a live link to a part, and that part's listing in one environment."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("supplier_id"))
    s = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("supplier_id"), F.col("c_mktsegment").alias("segment"))
    parts = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag").where("l_returnflag = 'N'")
    links = parts.groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.min("l_partkey").alias("product_id"), F.min("l_shipdate").alias("d"))
    links = links.withColumn("unmatched_at", F.when(F.col("listing_id") % 4 == 0, F.col("d"))).drop("d")
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    market = p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("listed_as"), F.explode(F.array(F.lit("SANDBOX"), F.lit("PRODUCTION"))).alias("environment"), F.lit("US").alias("marketplace"))
    return ops.product_screen(o, s, links, market, "US", "SANDBOX")


def review_queue(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_shipdate", "l_linestatus")
    c = c.select(F.col("l_orderkey").alias("listing_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("resolved_at"))
    listings = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "listing_id")
    products = table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumnRenamed("p_partkey", "product_id")
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumnRenamed("s_suppkey", "supplier_id")
    df = ops.review_queue(c, listings, products, suppliers)
    return df.groupBy("p_brand", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s_nationkey").alias("n_nations"))


def marketplaces(spark, sf_dir):
    """Each product in the one marketplace, a table of one row."""
    one = table(spark, sf_dir, "region", "r_regionkey", "r_name").where("r_regionkey = 0")
    return table(spark, sf_dir, "part", "p_partkey").crossJoin(F.broadcast(one))


def without_copy(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "product_id")
    g = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 48").withColumnRenamed("l_partkey", "product_id")
    return ops.without_copy(p, g)


def aspect_policy(spark, sf_dir):
    """Customers with the policy of their nation, where one is cached for the environment."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    policy = table(spark, sf_dir, "nation", "n_nationkey", "n_name").where("n_nationkey % 3 <> 0")
    policy = policy.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("policy"), F.explode(F.array(F.lit("SANDBOX"), F.lit("PRODUCTION"))).alias("environment"))
    return c.join(policy.where("environment = 'SANDBOX'").drop("environment"), "c_nationkey", "left").select("c_custkey", "policy")




def l2(spark, sf_dir):
    return ops.top(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), 25, _d("o_orderdate"), F.asc("o_orderkey"))


def l3(spark, sf_dir):
    return ops.top(table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), 50, _d("c_acctbal"), F.asc("c_custkey"))


def l4(spark, sf_dir):
    return ops.top(table(spark, sf_dir, "events", "event_id", "ts"), 50, _d("ts"), F.asc("event_id"))


def l5(spark, sf_dir):
    return ops.top(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 200, _d("o_totalprice"), F.asc("o_orderkey"))


def l6(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").withColumn("verified", F.col("p_size") >= 25)
    return ops.top(p, 200, F.asc("verified"), F.asc("p_name"), F.asc("p_partkey")).select("p_partkey", "verified", "p_name")


def l7(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").withColumn("active", F.col("s_acctbal") > 0)
    return s.orderBy(_d("active"), _d("s_acctbal"), F.asc("s_suppkey")).select("s_suppkey", "active", "s_acctbal")


def l8(spark, sf_dir):
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_name").orderBy("s_name")


def approved_batch(spark, sf_dir):
    """Orders waiting to be published; their customers' approvals name an environment and a payload."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("product_id"), F.col("o_orderpriority").alias("payload_hash"))
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("product_id"), F.when(F.col("c_custkey") % 5 == 0, "PRODUCTION").otherwise("SANDBOX").alias("environment"),
        F.when(F.col("c_custkey") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("payload_hash"),
    )
    df = publishing.approved_batch(o, a, "SANDBOX", dry_run=False, cap=20)
    return df.select("listing_id", F.coalesce("block_reason", F.lit("send")).alias("outcome"))


def several_approvals(spark, sf_dir):
    """Orders waiting to be published, with an approval for each line: of old and new payloads, here and elsewhere."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_orderkey").alias("product_id"), (F.col("o_custkey") % 4).cast("string").alias("payload_hash"))
    a = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").where("l_partkey % 3 <> 0").select(
        F.col("l_orderkey").alias("product_id"), F.when(F.col("l_partkey") % 5 == 0, "SANDBOX").otherwise("PRODUCTION").alias("environment"), (F.col("l_partkey") % 4).cast("string").alias("payload_hash")
    )
    df = publishing.approved_batch(o, a, "PRODUCTION", dry_run=False, allow_production=True, cap=100)
    return df.select("listing_id", F.coalesce("block_reason", F.lit("send")).alias("outcome"))


def top_window(spark, sf_dir):
    """The first five orders of each customer segment."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    w = Window.partitionBy("c_mktsegment").orderBy("o_orderdate", "o_orderkey")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("n", F.row_number().over(w))
    return df.where("n <= 5").select("c_mktsegment", "o_orderkey", "n")


QUERIES = {
    "a1_dashboard": (
        dashboard,
        """SELECT * FROM (SELECT count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'P') AS n_pending, count(*) FILTER (o_orderpriority[1] = '1') AS n_urgent FROM orders),
           (SELECT count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_returnflag = 'A') AS n_accepted, count(*) FILTER (l_discount > 0) AS n_discounted FROM lineitem),
           (SELECT count(*) AS n_parts, count(*) FILTER (p_size < 10) AS n_small, count(*) FILTER (p_type = 'ECONOMY') AS n_economy FROM part)""",
    ),
    "a2_name_counts": (name_counts, "SELECT count(*) AS total, count(*) FILTER (p_size >= 25) AS verified FROM part"),
    "a3_per_supplier": (per_supplier, "SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'N') AS n_live FROM supplier"),
    "a4_per_listing_images": (per_part, "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_images FROM part"),
    "f1_filter_by_verdict": (verdicts, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "f2_search_names": (search, "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%'"),
    "f3_live_rows": (live_rows, "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "f4_recent_members": (recent_members, "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND ts > TIMESTAMP '2024-01-05' - INTERVAL 24 HOURS"),
    "j1_listing_supplier": (supplier_join, "SELECT s_name, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "j2_j3_product_screen": (
        product_screen,
        """SELECT o_orderkey AS listing_id, o_custkey AS supplier_id, c_mktsegment AS segment, product_id, p_name AS listed_as FROM orders JOIN customer ON o_custkey = c_custkey
           LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS product_id FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey % 4 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = product_id""",
    ),
    "j4_review_queue": (
        review_queue,
        """SELECT p_brand, o_orderpriority, count(*) AS n, count(DISTINCT s_nationkey) AS n_nations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
           JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus <> 'F' GROUP BY 1, 2""",
    ),
    "j5_product_marketplace": (marketplaces, "SELECT p_partkey, r_regionkey, r_name FROM part, region WHERE r_regionkey = 0"),
    "j7_without_copy": (without_copy, "SELECT p_partkey AS product_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)"),
    "j8_aspect_policy": (aspect_policy, "SELECT c_custkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS policy FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "l2_needing_copy": (l2, "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25"),
    "l3_review_queue": (l3, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50"),
    "l4_links": (l4, "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50"),
    "l5_products": (l5, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200"),
    "l6_dictionary": (l6, "SELECT p_partkey, p_size >= 25 AS verified, p_name FROM part ORDER BY 2, 3, 1 LIMIT 200"),
    "l7_cost_profiles": (l7, "SELECT s_suppkey, s_acctbal > 0 AS active, s_acctbal FROM supplier ORDER BY 2 DESC, 3 DESC, 1"),
    "l8_suppliers": (l8, "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name"),
    "f7_j17_w7_approved_batch": (
        approved_batch,
        """WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR c_custkey IS NULL THEN 'no approval' WHEN o_custkey % 5 = 0 THEN 'approved for another environment'
             WHEN o_orderpriority <> CASE WHEN o_custkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END THEN 'payload changed since the approval' END AS why FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
           SELECT o_orderkey AS listing_id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL ORDER BY o_orderkey) <= 20 THEN 'send' ELSE 'run cap reached' END) AS outcome FROM d""",
    ),
    "f2_indexed_search": (
        indexed_search,
        " UNION ALL ".join(f"SELECT '{p}' AS pattern, p_partkey FROM part WHERE p_name ILIKE '{p}' OR p_brand ILIKE '{p}'" for p in PATTERNS),
    ),
    "f7_j17_several_approvals": (
        several_approvals,
        """WITH a AS (SELECT l_orderkey, l_partkey % 5 <> 0 AS here, l_partkey % 4 AS h FROM lineitem WHERE l_partkey % 3 <> 0),
           d AS (SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM a) THEN 'no approval' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM a WHERE here) THEN 'approved for another environment'
             WHEN NOT EXISTS (SELECT 1 FROM a WHERE here AND l_orderkey = o_orderkey AND h = o_custkey % 4) THEN 'payload changed since the approval' END AS why FROM orders)
           SELECT o_orderkey AS listing_id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL ORDER BY o_orderkey) <= 100 THEN 'send' ELSE 'run cap reached' END) AS outcome FROM d""",
    ),
    "w7_first_per_group": (
        top_window,
        "SELECT c_mktsegment, o_orderkey, n FROM (SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n <= 5",
    ),
}
