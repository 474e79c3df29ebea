"""Landed cost of supplier offers, their ranking, and the recommended source of each product."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, dec


@dataclass(frozen=True)
class Weights:
    """What a day of waiting costs (yen), and how much an expected cancellation costs relative to the landed cost."""

    per_day: str = "50"
    risk: str = "1"


def landed_cost(offers: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adds landed, penalties, effective cost, available stock, purchasable and reasons.

    Only IN_STOCK sells; an unknown count is one unit, never more.
    """
    landed = (F.col("price") + F.col("domestic_shipping") + F.col("handling")).cast(MONEY)
    wait = (dec(weights.per_day) * F.col("lead_time_days").cast("decimal(9,0)")).cast(MONEY)
    doubt = F.greatest(F.lit(0), F.least(F.lit(1), 1 - F.col("reliability").cast("decimal(7,6)"))).cast("decimal(7,6)")
    df = offers.withColumn("landed_cost", landed).withColumn("lead_time_penalty", wait)
    df = df.withColumn(
        "risk_penalty",
        (F.col("landed_cost").cast("decimal(18,6)") * doubt * F.lit(weights.risk).cast("decimal(5,3)")).cast(MONEY),
    )
    df = df.withColumn("effective_cost", (F.col("landed_cost") + F.col("lead_time_penalty") + F.col("risk_penalty")).cast(MONEY))
    stock = F.when(F.col("stock_status") != "IN_STOCK", 0).when(F.col("stock_qty").isNull(), 1)
    df = df.withColumn("available", stock.otherwise(F.greatest(F.lit(0), F.col("stock_qty") - F.col("safety_stock"))).cast("int"))
    df = df.withColumn("purchasable", (F.col("available") > 0) & (F.col("price") != 0))
    notes = F.array(
        F.when(F.col("stock_status") == "OUT_OF_STOCK", F.lit("out of stock")),
        F.when(F.col("stock_status") == "UNKNOWN", F.lit("stock unknown")),
        F.when((F.col("stock_status") == "IN_STOCK") & (F.col("available") == 0), F.lit("held as safety stock")),
        F.when(F.col("price") == 0, F.lit("price is zero")),
    )
    return df.withColumn("reasons", F.filter(notes, lambda x: x.isNotNull()))


def rank_sources(costed: DataFrame, product: str = "product_id", tie: str = "supplier_id") -> DataFrame:
    """Adds ``rank`` within the product: purchasable first, then effective cost, trust, lead time, id."""
    order = Window.partitionBy(product).orderBy(
        F.desc("purchasable"), F.asc("effective_cost"), F.desc("trust"), F.asc("lead_time_days"), F.asc(tie)
    )
    return costed.withColumn("rank", F.row_number().over(order))


def recommend_source(costed: DataFrame, product: str = "product_id", tie: str = "supplier_id", cap: int = 1) -> DataFrame:
    """The first purchasable source of each product and the quantity to list: never summed over shops.

    A minimum over structs does it, so offers are combined before the shuffle and no window sorts them.
    """
    order = F.struct(
        F.col("effective_cost"), (-F.col("trust")).alias("distrust"), F.col("lead_time_days"), F.col(tie).alias("tie"),
        F.struct(*costed.columns).alias("row"),
    )
    best = costed.where("purchasable").groupBy(product).agg(F.min(order).alias("best")).select("best.row.*")
    return best.withColumn("quantity", F.least("available", F.lit(cap)))
