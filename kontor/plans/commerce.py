"""Sourcing, profit and market queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import market, profit, sourcing
from ..operators.bands import band_join
from ..operators.ordered import as_of_join
from .stand_ins import COSTED_SQL, OFFERS_SQL, PROFIT_SQL, SALE_SQL, offers, sale_offers, table


def _num(*names: str, places: int = 4):
    return [F.round(F.col(n).cast("double"), places).alias(n) for n in names]


def best_source_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each product the recommended source and its base-case profit, where that meets the floor of 1500 yen."""
    best = sourcing.recommend_source(sourcing.landed_cost(offers(spark, sf_dir)))
    priced = best.select(
        "product_id", "supplier_id", "quantity", F.col("price").alias("purchase_price"), F.col("domestic_shipping").alias("domestic_shipping_jpy"),
        F.col("handling").alias("handling_jpy"), F.lit("150").cast("decimal(20,10)").alias("fx_rate"),
        F.round(F.col("price").cast("double") * (1.5 + F.col("product_id") % 5 * 0.25) / 150 + 0.001, 2).cast("decimal(20,6)").alias("selling_price"),
    )
    out = profit.profit_scenarios(priced, only=("BASE",)).where(F.col("profit_jpy") >= 1500)
    return out.select("product_id", "supplier_id", "quantity", *_num("profit", places=6), *_num("profit_jpy", places=7), *_num("margin_percent"))


def landed_cost(spark, sf_dir):
    df = sourcing.landed_cost(offers(spark, sf_dir))
    return df.select("product_id", "supplier_id", "available", "purchasable", *_num("landed_cost", "effective_cost"), F.size("reasons").cast("long").alias("n_reasons"))


def rank_sources(spark, sf_dir):
    return sourcing.rank_sources(sourcing.landed_cost(offers(spark, sf_dir))).select("product_id", "supplier_id", "rank")


def recommend_source(spark, sf_dir):
    return sourcing.recommend_source(sourcing.landed_cost(offers(spark, sf_dir))).select("product_id", "supplier_id", "quantity")


def profit_scenarios(spark, sf_dir):
    df = profit.profit_scenarios(sale_offers(spark, sf_dir))
    return df.select("offer_id", "scenario", *_num("total_cost", "profit", places=6), *_num("profit_jpy", places=7), (F.col("margin_percent") >= 15).alias("meets_margin"), (F.col("profit") < 0).alias("loss"))


def sum_costs(spark, sf_dir):
    """Exact sums of the cost components over products, one currency."""
    df = profit.profit_scenarios(sale_offers(spark, sf_dir), only=("BASE",))
    return df.groupBy("product_id").agg(F.sum("total_cost").alias("c"), F.sum("cost_purchase").alias("p")).select(
        "product_id", F.round(F.col("c").cast("double"), 6).alias("total_cost"), F.round(F.col("p").cast("double"), 3).alias("purchase")
    )


def customs_cost(spark, sf_dir):
    terms = profit.Terms(mode="SELLER_PAID", de_minimis="150", duty="5", import_tax="20")
    df = profit.profit_scenarios(sale_offers(spark, sf_dir), terms, ("BASE",))
    return df.select("offer_id", *_num("cost_duty", "cost_import_tax"))


def price_floor(spark, sf_dir):
    df = profit.price_floor(sale_offers(spark, sf_dir))
    return df.select("offer_id", F.round(F.col("minimum_price").cast("double"), 2).alias("minimum_price"), "verified")


def profit_snapshots(spark, sf_dir):
    terms = profit.Terms()
    df = profit.profit_snapshots(profit.profit_scenarios(sale_offers(spark, sf_dir), terms), terms, ["offer_id"])
    return df.select("offer_id", "scenario", F.get_json_object("settings", "$.category_fee").alias("category_fee"), F.size("warnings").cast("long").alias("n_warnings"))


def fx_convert(spark, sf_dir):
    """Account balances in yen by their nation's rate; nations without a positive rate are left out."""
    rates = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, 100 + F.col("n_nationkey")).otherwise(F.lit(0)).cast("decimal(20,10)").alias("rate"))
    df = table(spark, sf_dir, "customer").join(F.broadcast(rates), F.col("c_nationkey") == F.col("n_nationkey"))
    good, _ = money.convert(df.withColumn("amount", F.round("c_acctbal", 2).cast("decimal(20,6)")), "amount", "rate", "jpy")
    return good.select("c_custkey", *_num("jpy", places=2))


def shipping_band(spark, sf_dir):
    """The most specific shipping rule for each order: its nation's region, then any; half-open bands of value."""
    rows = [(1, 0, 0, 100000, 10), (2, 0, 100000, None, 20), (3, None, 0, 50000, 30), (4, None, 50000, 200000, 40), (5, None, 200000, None, 50), (6, 1, 0, None, 60)]
    bands = spark.createDataFrame(rows, "band_id int, region int, low int, high int, cost int")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"))
    order = [F.col("region").isNull(), F.col("region"), F.col("band_id")]
    return band_join(facts, bands, ["o_orderkey"], "o_totalprice", "low", "high", {"n_regionkey": "region"}, order).select("o_orderkey", "band_id", "cost")


def many_bands(spark, sf_dir):
    """Each order's most specific rule of as many as there are lines: of its priority before any, narrow before wide; some have no end."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    low = F.round(F.col("l_extendedprice") * 3).cast("long")
    bands = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("band_id"), F.nullif(F.col("l_orderkey") % 7, F.lit(6)).alias("p"), low.alias("low"),
        F.when(F.col("l_orderkey") % 5000 == 0, None).when(F.col("l_orderkey") % 5000 == 1, low + 20_000).otherwise(low + F.col("l_quantity").cast("long")).alias("high"),
    )
    facts = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("own", F.col("o_custkey") % 6)
    order = [F.col("p").isNull(), F.coalesce(F.col("high") - F.col("low"), F.lit(2**40)), F.col("band_id")]
    return band_join(facts, bands, ["o_orderkey"], "o_totalprice", "low", "high", {"own": "p"}, order).select("o_orderkey", "band_id")


def customs_band(spark, sf_dir):
    rows = [(0, 50000, 0), (50000, 150000, 5), (150000, None, 10)]
    bands = spark.createDataFrame(rows, "low int, high int, rate int")
    facts = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return band_join(facts, bands, ["o_orderkey"], "o_totalprice", "low", "high", order=[F.col("low")]).select("o_orderkey", "rate")


def cost_profile(spark, sf_dir):
    """The cost profile in force on each order's date."""
    rows = [(1, "1990-01-01", True, 10), (2, "1996-06-01", True, 11), (3, "1998-01-01", False, 12), (4, "1999-03-01", True, 13)]
    profiles = spark.createDataFrame(rows, "profile_id int, d string, is_active boolean, fee int").withColumn("effective_from", F.to_timestamp("d")).drop("d")
    facts = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return profit.profile_as_of(facts, profiles, "o_orderdate").select("o_orderkey", "profile_id", "fee")


def supplier_profiles(spark, sf_dir):
    """The profile of its supplier in force when each line was shipped; orders are the profiles, of the supplier of their first line."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    first = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("supplier"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus <> 'P'")
    profiles = o.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("supplier", F.col("o_orderkey").alias("profile_id"), F.col("o_orderdate").alias("effective_from"))
    facts = lines.withColumnRenamed("l_suppkey", "supplier")
    found = as_of_join(facts, profiles, ["supplier"], "l_shipdate", "effective_from", [F.col("profile_id")])
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", "supplier", "profile_id")


def _asks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    currency = F.when(F.col("l_returnflag") == "N", "USD").when(F.col("l_returnflag") == "R", "EUR")
    return lines.select(
        F.col("l_partkey").alias("query_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate").alias("position"), F.col("l_orderkey").alias("item_id"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") + 0.0001, 2).cast("decimal(20,6)").alias("price"), currency.alias("currency"), "l_shipdate",
    )


def summarise_asks(spark, sf_dir):
    df = market.summarise_asks(_asks(spark, sf_dir))
    return df.select("query_id", "currency", *_num("active_min", "active_median", "active_max"), "active_count", "n_other_currency", F.size("caveats").cast("long").alias("n_caveats"))


ASKS = """asks AS (SELECT l_partkey AS q, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, round(l_extendedprice / l_quantity + 0.0001, 2) AS price,
  CASE l_returnflag WHEN 'N' THEN 'USD' WHEN 'R' THEN 'EUR' END AS currency FROM lineitem)"""


def market_staleness(spark, sf_dir):
    obs = _asks(spark, sf_dir).select(F.col("query_id").alias("product_id"), F.col("l_shipdate").alias("collected_at"))
    return market.market_staleness(obs)


def stalest_first(spark, sf_dir):
    products = table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "product_id")
    obs = _asks(spark, sf_dir).where("currency is not null").select(F.col("query_id").alias("product_id"), F.col("l_shipdate").alias("collected_at"))
    return market.stalest_first(products, obs)


def market_sufficiency(spark, sf_dir):
    obs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("collected_at"), F.lit(1).alias("sold_count"))
    return market.market_sufficiency(obs, F.to_timestamp(F.lit("2000-01-01")))


def anomalous_prices(spark, sf_dir):
    """Offers above 1.5 times the median of their product."""
    own = offers(spark, sf_dir).select("product_id", "supplier_id", "price")
    odd = market.anomalous_prices(own, market.exact_lower_median(own, "product_id", "price"), 1.5)
    return odd.select("product_id", "supplier_id", *_num("price", "median"))


def observations(spark, sf_dir):
    """Append-ready market observations: summaries marked as not sufficient."""
    df = market.summarise_asks(_asks(spark, sf_dir)).where("active_count > 0")
    return df.select(F.col("query_id").alias("product_id"), *_num("active_min", "active_max"), "active_count", "is_sufficient")


P = f"SELECT * FROM ({PROFIT_SQL})"
QUERIES = {
    "slice_best_source_profit": (
        best_source_profit,
        f"""WITH best AS (SELECT product_id, supplier_id, row_number() OVER (PARTITION BY product_id ORDER BY effective_cost, trust DESC, lead_time_days, supplier_id) AS n,
              least(available, 1) AS quantity FROM ({COSTED_SQL}) WHERE purchasable)
            SELECT product_id, supplier_id, quantity, round(profit, 6) AS profit, round(profit * rate, 7) AS profit_jpy, round(profit / revenue * 100, 4) AS margin_percent
            FROM ({PROFIT_SQL}) JOIN best USING (product_id, supplier_id) WHERE n = 1 AND scenario = 'BASE' AND profit * rate >= 1500""",
    ),
    "b6_landed_cost": (
        landed_cost,
        f"""SELECT product_id, supplier_id, available, purchasable, round(landed_cost::DOUBLE, 4) AS landed_cost, round(effective_cost::DOUBLE, 4) AS effective_cost,
            (stock_status <> 'IN_STOCK')::INT + (stock_status = 'IN_STOCK' AND available = 0)::INT + (price = 0)::INT AS n_reasons FROM ({COSTED_SQL})""",
    ),
    "w1_rank_sources": (
        rank_sources,
        f"""SELECT product_id, supplier_id, row_number() OVER (PARTITION BY product_id ORDER BY purchasable DESC, effective_cost, trust DESC, lead_time_days, supplier_id) AS rank FROM ({COSTED_SQL})""",
    ),
    "b7_recommend_source": (
        recommend_source,
        f"""SELECT product_id, supplier_id, quantity FROM (SELECT product_id, supplier_id, least(available, 1) AS quantity,
              row_number() OVER (PARTITION BY product_id ORDER BY effective_cost, trust DESC, lead_time_days, supplier_id) AS n FROM ({COSTED_SQL}) WHERE purchasable) WHERE n = 1""",
    ),
    "b8_j13_profit_scenarios": (
        profit_scenarios,
        f"""SELECT offer_id, scenario, round(total_cost, 6) AS total_cost, round(profit, 6) AS profit, round(profit * rate, 7) AS profit_jpy,
            round(profit / revenue * 100, 4) >= 15 AS meets_margin, profit < 0 AS loss FROM ({PROFIT_SQL})""",
    ),
    "a7_sum_costs": (
        sum_costs,
        f"""SELECT product_id, round(sum(total_cost), 6) AS total_cost, round(sum(round(purchase_price / rate, 6)), 3) AS purchase FROM ({PROFIT_SQL}) WHERE scenario = 'BASE' GROUP BY product_id""",
    ),
    "b9_customs_cost": (
        customs_cost,
        f"""SELECT offer_id, CASE WHEN p < 150 THEN 0 ELSE round(p * 0.05, 4) END AS cost_duty, CASE WHEN p < 150 THEN 0 ELSE round(p * 1.05 * 0.2, 4) END AS cost_import_tax
            FROM (SELECT offer_id, selling_price::DOUBLE AS p FROM ({SALE_SQL}))""",
    ),
    "b10_price_floor": (
        price_floor,
        f"""WITH c AS (SELECT offer_id, round(purchase_price / 142.5, 6) + round(domestic_shipping_jpy / 142.5, 6) + round(handling_jpy / 142.5, 6)
              + round(3500 * 1.15 / 142.5, 6) + round(250 / 142.5, 6) + 0.40 AS fixed FROM ({SALE_SQL})),
            x AS (SELECT offer_id, greatest((1500 / 142.5 + fixed) / (1 - 0.254) - 15, fixed / (1 - 0.254 - 0.15) - 15, 0.01) AS price FROM c)
            SELECT offer_id, ceil(round(price * 100, 6)) / 100 AS minimum_price, true AS verified FROM x""",
    ),
    "b19_profit_snapshots": (
        profit_snapshots,
        f"""SELECT offer_id, scenario, '13.25' AS category_fee, (selling_price <= 0)::INT + (purchase_price = 0)::INT + (profit < 0)::INT AS n_warnings FROM ({PROFIT_SQL})""",
    ),
    "b11_fx_convert": (
        fx_convert,
        "SELECT c_custkey, round(round(c_acctbal, 2) * (100 + c_nationkey), 2) AS jpy FROM customer WHERE c_nationkey % 4 <> 0",
    ),
    "j14_shipping_band": (
        shipping_band,
        """WITH b(band_id, region, low, high, cost) AS (VALUES (1, 0, 0, 100000, 10), (2, 0, 100000, NULL, 20), (3, NULL, 0, 50000, 30), (4, NULL, 50000, 200000, 40), (5, NULL, 200000, NULL, 50), (6, 1, 0, NULL, 60)),
           m AS (SELECT o_orderkey, band_id, cost, row_number() OVER (PARTITION BY o_orderkey ORDER BY region NULLS LAST, band_id) AS n
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN b ON (region IS NULL OR region = n_regionkey) AND o_totalprice >= low AND (high IS NULL OR o_totalprice < high))
           SELECT o_orderkey, band_id, cost FROM m WHERE n = 1""",
    ),
    "j14_j15_many_bands": (
        many_bands,
        """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS band_id, nullif(l_orderkey % 7, 6) AS p, CAST(round(l_extendedprice * 3) AS BIGINT) AS low,
             CASE WHEN l_orderkey % 5000 = 0 THEN NULL WHEN l_orderkey % 5000 = 1 THEN low + 20000 ELSE low + CAST(l_quantity AS BIGINT) END AS high FROM lineitem),
           m AS (SELECT o_orderkey, band_id, p, high, low FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < coalesce(high, 1e18) WHERE p IS NULL OR p = o_custkey % 6)
           SELECT o_orderkey, best.band_id FROM orders LEFT JOIN (
             SELECT o_orderkey, band_id FROM m QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p IS NULL, coalesce(high - low, 1099511627776), band_id) = 1) AS best USING (o_orderkey)""",
    ),
    "j15_customs_band": (
        customs_band,
        "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 5 ELSE 10 END AS rate FROM orders",
    ),
    "j16_supplier_profiles": (
        supplier_profiles,
        """WITH f AS (SELECT l_orderkey, l_suppkey AS supplier FROM lineitem WHERE l_linenumber = 1),
           p AS (SELECT supplier, o_orderdate AS since, min(o_orderkey) AS profile_id FROM orders JOIN f ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
           SELECT l_orderkey, l_linenumber, l_extendedprice, l_suppkey AS supplier, profile_id FROM lineitem ASOF LEFT JOIN p ON l_suppkey = supplier AND l_shipdate >= since""",
    ),
    "j16_cost_profile": (
        cost_profile,
        """SELECT o_orderkey, CASE WHEN o_orderdate >= '1999-03-01' THEN 4 WHEN o_orderdate >= '1996-06-01' THEN 2 WHEN o_orderdate >= '1990-01-01' THEN 1 END AS profile_id,
           CASE WHEN o_orderdate >= '1999-03-01' THEN 13 WHEN o_orderdate >= '1996-06-01' THEN 11 WHEN o_orderdate >= '1990-01-01' THEN 10 END AS fee FROM orders""",
    ),
    "a5_w6_summarise_asks": (
        summarise_asks,
        f"""WITH {ASKS}, main AS (SELECT q, arg_min(currency, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate)) AS main FROM asks WHERE currency IS NOT NULL GROUP BY q)
            SELECT asks.q AS query_id, any_value(main) AS currency, min(price) FILTER (currency = main) AS active_min, quantile_disc(price, 0.5) FILTER (currency = main) AS active_median,
              max(price) FILTER (currency = main) AS active_max, count(*) FILTER (currency = main) AS active_count, count(*) FILTER (currency <> main) AS n_other_currency,
              (count(*) FILTER (currency <> main) > 0)::INT + (count(*) FILTER (currency = main) BETWEEN 1 AND 2)::INT AS n_caveats
            FROM asks LEFT JOIN main ON asks.q = main.q GROUP BY asks.q""",
    ),
    "snk5_market_observations": (
        observations,
        f"""WITH {ASKS}, main AS (SELECT q, arg_min(currency, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate)) AS main FROM asks WHERE currency IS NOT NULL GROUP BY q)
            SELECT asks.q AS product_id, min(price) AS active_min, max(price) AS active_max, count(*) AS active_count, false AS is_sufficient FROM asks JOIN main ON asks.q = main.q AND currency = main GROUP BY asks.q""",
    ),
    "a9_j6_market_staleness": (market_staleness, "SELECT l_partkey AS product_id, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1"),
    "l1_stalest_first": (
        stalest_first,
        """SELECT p_partkey AS product_id, last_seen FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_seen FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1) ON l_partkey = p_partkey
           ORDER BY last_seen NULLS FIRST, p_partkey LIMIT 50""",
    ),
    "b13_market_sufficiency": (
        market_sufficiency,
        """SELECT l_partkey AS product_id, count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAYS) AS comparables,
           count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAYS) >= 3 AS is_sufficient FROM lineitem GROUP BY 1""",
    ),
    "b14_anomalous_prices": (
        anomalous_prices,
        f"""WITH o AS ({OFFERS_SQL}), m AS (SELECT product_id, quantile_disc(price, 0.5) AS median FROM o GROUP BY 1)
            SELECT product_id, supplier_id, price::DOUBLE AS price, median::DOUBLE AS median FROM o JOIN m USING (product_id) WHERE price > median * 1.5""",
    ),
}
