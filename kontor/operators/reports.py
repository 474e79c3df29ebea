"""The screens' queries as DataFrame functions: joins with their review predicates, counts, and ordered lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_by_verdict(df: DataFrame, verdict: str | None) -> DataFrame:
    return df if verdict is None else df.where(F.col("verdict") == verdict)


def search_names(names: DataFrame, pattern: str | None) -> DataFrame:
    """No pattern gives all; else a case-insensitive match on either name."""
    return names if pattern is None else names.where(F.col("name_ja").ilike(pattern) | F.col("name_en").ilike(pattern))


def live(df: DataFrame, ended: str) -> DataFrame:
    """Rows whose ``ended`` time is not set."""
    return df.where(F.col(ended).isNull())


def recent(df: DataFrame, column: str, as_of: Column, hours: int = 24) -> DataFrame:
    return df.where(F.col(column) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side, each of one row."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def per_key_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Each parent with the number of its children, 0 where there are none."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def product_screen(listings: DataFrame, suppliers: DataFrame, links: DataFrame, market: DataFrame, marketplace: str, environment: str) -> DataFrame:
    """Listings with their supplier, live link and marketplace listing; the environment is part of the key, so nothing fans out."""
    own = market.where((F.col("marketplace") == marketplace) & (F.col("environment") == environment)).drop("marketplace", "environment")
    df = listings.join(suppliers, "supplier_id").join(live(links, "unmatched_at").drop("unmatched_at"), "listing_id", "left")
    return df.join(own, "product_id", "left")


def review_queue(candidates: DataFrame, listings: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Unresolved candidates with what they compare."""
    open_ = live(candidates, "resolved_at").drop("resolved_at")
    return open_.join(listings, "listing_id").join(products, "product_id").join(suppliers, "supplier_id")


def without_copy(products: DataFrame, generated: DataFrame) -> DataFrame:
    return products.join(generated.select("product_id").distinct(), "product_id", "left_anti")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows; the last key must be unique so that the answer is."""
    return df.orderBy(*order).limit(n)
