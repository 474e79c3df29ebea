"""The driver's tables seen as listings, offers, dictionaries and observations, so that every operator has whole tables to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listings import latest


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table of few bytes, which is read in one or two tasks, dealt out for work that is long for each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest line of each part and supplier as an offer in yen, with the supplier's terms."""
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    newest = latest(lines, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    df = newest.join(suppliers, newest.l_suppkey == suppliers.s_suppkey)
    unit = F.round(F.col("l_extendedprice") * 10 / F.col("l_quantity"), 0).cast("decimal(20,6)")
    status = F.when(F.col("l_returnflag") == "R", "OUT_OF_STOCK").when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 13 == 0), "UNKNOWN").otherwise("IN_STOCK")
    return df.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        unit.alias("price"),
        (F.lit(300) + F.col("l_suppkey") % 5 * 100).cast("decimal(20,6)").alias("domestic_shipping"),
        (F.col("l_partkey") % 3 * 50).cast("decimal(20,6)").alias("handling"),
        (F.col("l_suppkey") % 7).cast("int").alias("lead_time_days"),
        (1 - F.col("l_suppkey") % 10 * F.lit("0.03").cast("decimal(4,2)")).cast("decimal(5,4)").alias("reliability"),
        F.round("s_acctbal", 2).cast("decimal(10,2)").alias("trust"),
        status.alias("stock_status"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("stock_qty"),
        (F.col("l_suppkey") % 3).cast("int").alias("safety_stock"),
    )


OFFERS_SQL = """
SELECT l_partkey AS product_id, l_suppkey AS supplier_id,
  CAST(round(l_extendedprice * 10 / l_quantity, 0) AS DECIMAL(20,6)) AS price,
  CAST(300 + l_suppkey % 5 * 100 AS DECIMAL(20,6)) AS domestic_shipping, CAST(l_partkey % 3 * 50 AS DECIMAL(20,6)) AS handling,
  CAST(l_suppkey % 7 AS INTEGER) AS lead_time_days, CAST(1 - l_suppkey % 10 * 0.03 AS DECIMAL(5,4)) AS reliability,
  CAST(round(s_acctbal, 2) AS DECIMAL(10,2)) AS trust,
  CASE WHEN l_returnflag = 'R' THEN 'OUT_OF_STOCK' WHEN l_returnflag = 'A' AND l_suppkey % 13 = 0 THEN 'UNKNOWN' ELSE 'IN_STOCK' END AS stock_status,
  CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) END AS stock_qty, CAST(l_suppkey % 3 AS INTEGER) AS safety_stock
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem)
JOIN supplier ON l_suppkey = s_suppkey WHERE n = 1
"""

COSTED_SQL = f"""
SELECT *, landed_cost + lead_time_penalty + risk_penalty AS effective_cost,
  available > 0 AND price <> 0 AS purchasable
FROM (SELECT *, CAST(price + domestic_shipping + handling AS DECIMAL(20,6)) AS landed_cost,
        CAST(50 * lead_time_days AS DECIMAL(20,6)) AS lead_time_penalty,
        CAST((price + domestic_shipping + handling) * CAST(1 - reliability AS DECIMAL(7,4)) AS DECIMAL(20,6)) AS risk_penalty,
        CASE WHEN stock_status <> 'IN_STOCK' THEN 0 WHEN stock_qty IS NULL THEN 1 ELSE greatest(0, stock_qty - safety_stock) END AS available
      FROM ({OFFERS_SQL}))
"""


def sale_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with a selling price in dollars and an exchange rate, ready for profit."""
    df = offers(spark, sf_dir)
    return df.select(
        (F.col("product_id") * 100_000 + F.col("supplier_id")).alias("offer_id"), "product_id", "supplier_id",
        F.col("price").alias("purchase_price"), F.col("domestic_shipping").alias("domestic_shipping_jpy"), F.col("handling").alias("handling_jpy"),
        F.round(F.col("price").cast("double") * (1.5 + F.col("product_id") % 5 * 0.25) / 150 + 0.001, 2).cast("decimal(20,6)").alias("selling_price"),
        F.lit("150").cast("decimal(20,10)").alias("fx_rate"),
    )


SALE_SQL = f"""
SELECT product_id * 100000 + supplier_id AS offer_id, product_id, supplier_id, price AS purchase_price,
  domestic_shipping AS domestic_shipping_jpy, handling AS handling_jpy,
  CAST(round(CAST(price AS DOUBLE) * (1.5 + product_id % 5 * 0.25) / 150 + 0.001, 2) AS DECIMAL(20,6)) AS selling_price
FROM ({OFFERS_SQL})
"""

# One row per offer and scenario: the sums that profit needs, in exact decimals where products are exact and rounded where the rule rounds.
PROFIT_SQL = f"""
SELECT *, revenue - total_cost AS profit FROM (
 SELECT *, round(purchase_price / rate, 6) + round(domestic_shipping_jpy / rate, 6) + round(handling_jpy / rate, 6)
    + round(3500 * (1 + dearer / 100) / rate, 6) + round(250 / rate, 6) + 0.40
    + revenue * (13.25 + 1.65 + 2 + 1.5 + 3 + 2 * returns) / 100 AS total_cost
 FROM (SELECT s.*, scenario, dearer, returns, 150 * (1 - adverse / 100) AS rate, CAST(selling_price AS DOUBLE) + 15 AS revenue
       FROM ({SALE_SQL}) AS s,
       (VALUES ('OPTIMISTIC', 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), ('BASE', 0, 0, 1), ('PESSIMISTIC', 5, 15, 2)) AS c(scenario, adverse, dearer, returns)))
"""


def listing_rows(o: DataFrame) -> DataFrame:
    """Orders, of a table or a stream, as listings."""
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 50).alias("supplier_id"), k.alias("source_product_id"), F.round("o_totalprice", 2).cast("decimal(20,6)").alias("price"),
        F.when(F.col("o_orderstatus") == "F", "OUT_OF_STOCK").otherwise("IN_STOCK").alias("stock_status"), (k % 9).cast("int").alias("stock_qty"),
    )


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("price").cast("string"), "stock_status", F.col("stock_qty").cast("string")), 256))


def delivered(base: DataFrame) -> DataFrame:
    """What is delivered next of ``listing_rows``: some are gone, some changed, some are rejected."""
    p = F.col("source_product_id")
    new = base.where(p % 11 != 0).withColumn("price", F.when(p % 5 == 0, F.col("price") + 10).otherwise(F.col("price")).cast("decimal(20,6)"))
    new = hashed(new.withColumn("stock_qty", F.when(p % 6 == 0, F.col("stock_qty") + 1).otherwise(F.col("stock_qty")).cast("int")))
    new = new.withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-01 06:00:00")))
    return new.withColumn("verdict", F.when(p % 13 == 0, "REJECTED").when(p % 17 == 0, "REVIEW").otherwise("CONFIRMED"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, incoming) listings from orders: some are new, some vanish, some change price, stock, or nothing; some
    are rejected, and some were delivered twice, an hour before with another price."""
    base = listing_rows(table(spark, sf_dir, "orders"))
    p = F.col("source_product_id")
    new = delivered(base)
    early = new.where(p % 19 == 0).withColumn("price", (F.col("price") + 99).cast("decimal(20,6)")).withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-01 05:00:00")))
    return hashed(base.where(p % 7 != 0)), new.unionByName(early)


SNAPSHOT_SQL = """
base AS (SELECT o_custkey % 50 AS supplier_id, o_orderkey AS p, CAST(round(o_totalprice, 2) AS DECIMAL(20,6)) AS price,
           CASE WHEN o_orderstatus = 'F' THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS stock_status, o_orderkey % 9 AS stock_qty FROM orders),
cur AS (SELECT * FROM base WHERE p % 7 <> 0),
inc AS (SELECT supplier_id, p, CASE WHEN p % 5 = 0 THEN price + 10 ELSE price END AS price, stock_status,
          CASE WHEN p % 6 = 0 THEN stock_qty + 1 ELSE stock_qty END AS stock_qty,
          CASE WHEN p % 13 = 0 THEN 'REJECTED' WHEN p % 17 = 0 THEN 'REVIEW' ELSE 'CONFIRMED' END AS verdict FROM base WHERE p % 11 <> 0),
diff AS (SELECT coalesce(c.supplier_id, i.supplier_id) AS supplier_id, coalesce(c.p, i.p) AS p, i.price, i.stock_status, i.stock_qty, i.verdict,
           CASE WHEN i.p IS NULL THEN 'unseen' WHEN i.verdict = 'REJECTED' THEN 'skipped' WHEN c.p IS NULL THEN 'created'
                WHEN c.price = i.price AND c.stock_status = i.stock_status AND c.stock_qty = i.stock_qty THEN 'unchanged' ELSE 'updated' END AS status,
           coalesce(i.verdict <> 'REJECTED' AND c.price <> i.price, false) AS price_changed,
           coalesce(i.verdict <> 'REJECTED', false) AND c.p IS NOT NULL AND (c.stock_status <> i.stock_status OR c.stock_qty <> i.stock_qty) AS stock_changed
         FROM cur AS c FULL OUTER JOIN inc AS i ON c.supplier_id = i.supplier_id AND c.p = i.p)
"""


def identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(listings, catalogue) from parts: even and odd keys, blocked by brand; some parts of an identity are unknown."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    df = p.select(
        k.alias("id"), F.lit(None).cast("string").alias("card_name_ja"), F.col("p_name").alias("card_name_en"),
        F.when(k % 17 != 0, F.concat(F.lit("N"), (F.col("p_size") % 12).cast("string"))).alias("card_number"),
        F.when(k % 5 != 0, F.substring("p_type", 1, 3)).alias("set_code"), F.lit(None).cast("string").alias("set_name"),
        F.when(k % 3 != 0, F.concat(F.lit("r"), (F.col("p_size") % 2).cast("string"))).alias("rarity"),
        (F.lit(2000) + F.col("p_size") % 3).cast("int").alias("release_year"), F.lit("JAPANESE").alias("language"),
        F.col("p_brand").alias("grading_company"), F.lit("10.0").cast("decimal(3,1)").alias("grade"),
    )
    return df.where("id % 2 = 0").withColumnRenamed("id", "listing_id"), df.where("id % 2 = 1").withColumnRenamed("id", "product_id")


IDENTITY_SQL = """
ident AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 17 <> 0 THEN 'N' || (p_size % 12) END AS num,
   CASE WHEN p_partkey % 5 <> 0 THEN p_type[1:3] END AS sc, CASE WHEN p_partkey % 3 <> 0 THEN 'r' || (p_size % 2) END AS rar,
   2000 + p_size % 3 AS yr, p_brand AS co FROM part),
pairs AS (SELECT a.id AS listing_id, b.id AS product_id, a.name AS an, b.name AS bn, a.num AS num, a.sc AS asc_, b.sc AS bsc, a.rar AS ar, b.rar AS br, a.yr AS ay, b.yr AS byr
   FROM ident AS a JOIN ident AS b ON a.num = b.num AND a.co = b.co WHERE a.id % 2 = 0 AND b.id % 2 = 1),
sim AS (SELECT *, replace(lower(an), ' ', '') AS x, replace(lower(bn), ' ', '') AS y FROM pairs),
scored AS (SELECT *, (0.3 + CASE WHEN asc_ = bsc THEN 0.25 ELSE 0 END + 0.25 * s + CASE WHEN ar = br THEN 0.1 ELSE 0 END + CASE WHEN ay = byr THEN 0.05 ELSE 0 END)
     / (0.3 + 0.25 + 0.05 + CASE WHEN asc_ IS NOT NULL AND bsc IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN ar IS NOT NULL AND br IS NOT NULL THEN 0.1 ELSE 0 END) AS score
   FROM (SELECT *, CASE WHEN x = y THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS s FROM sim)),
decided AS (SELECT *, CASE WHEN asc_ <> bsc THEN 'REJECT' WHEN ay <> byr THEN 'REVIEW' WHEN round(score, 9) < 0.75 THEN 'REJECT'
     WHEN round(score, 9) >= 0.95 AND asc_ = bsc THEN 'AUTO_MERGE' ELSE 'REVIEW' END AS decision FROM scored)
"""
