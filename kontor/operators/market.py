"""Market observations: summaries of asks, what to refresh first, sufficiency of comparables, anomalous prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def summarise_asks(asks: DataFrame, by: str = "query_id") -> DataFrame:
    """min, lower median, max and count of the asks in the first priced row's currency; others are counted, not converted.

    Columns read: position, item_id, price (decimal), currency.  The median is exact: equal prices are combined first,
    then a running count finds the middle, so a group of any size fits.
    """
    first = asks.where("currency is not null").groupBy(by).agg(F.min_by("currency", "position").alias("main"))
    df = asks.join(first, by, "left")
    good = F.col("item_id").isNotNull() & F.col("price").isNotNull() & F.col("currency").eqNullSafe(F.col("main"))
    sums = df.groupBy(by).agg(
        F.max("main").alias("currency"),
        F.min(F.when(good, F.col("price"))).alias("active_min"),
        F.max(F.when(good, F.col("price"))).alias("active_max"),
        F.count_if(good).alias("active_count"),
        F.count_if(F.col("currency") != F.col("main")).alias("n_other_currency"),
    )
    mids = exact_lower_median(df.where(good), by, "price").withColumnRenamed("median", "active_median")
    out = sums.join(mids, by, "left")
    few = F.col("active_count").between(1, 2)
    caveats = F.array(
        F.when(F.col("n_other_currency") > 0, F.lit("other currencies excluded")), F.when(few, F.lit("fewer than three"))
    )
    return out.withColumns({"is_sufficient": F.lit(False), "caveats": F.filter(caveats, lambda x: x.isNotNull())})


def exact_lower_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value of each group, the lower of two.  Only distinct values are gathered."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(by).orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(by))})
    middle = F.floor((F.col("all") - 1) / 2)
    return ranked.where((F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)).select(by, F.col(value).alias("median"))


def market_staleness(observations: DataFrame, key: str = "product_id") -> DataFrame:
    return observations.groupBy(key).agg(F.max("collected_at").alias("last_seen"))


def stalest_first(products: DataFrame, observations: DataFrame, n: int = 50, key: str = "product_id") -> DataFrame:
    """The ``n`` products whose last observation is oldest; never observed ones first."""
    return products.join(market_staleness(observations, key), key, "left").orderBy(F.asc_nulls_first("last_seen"), key).limit(n)


def market_sufficiency(observations: DataFrame, as_of: Column, least: int = 3, days: int = 90, key: str = "product_id") -> DataFrame:
    """Whether sold comparables within the window are enough."""
    fresh = F.col("collected_at") >= as_of - F.make_dt_interval(F.lit(days))
    return observations.groupBy(key).agg(
        F.coalesce(F.sum(F.when(fresh, F.col("sold_count"))), F.lit(0)).alias("comparables")
    ).withColumn("is_sufficient", F.col("comparables") >= least)


def anomalous_prices(offers: DataFrame, medians: DataFrame, factor: float = 3, key: str = "product_id") -> DataFrame:
    """Offers above ``factor`` times the market median."""
    return offers.join(medians, key).where(F.col("price") > F.col("median") * factor)
