"""Exact decimals: types, currency conversion, percentages and sums that neither overflow nor mix currencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY, RATE, PERCENT, SCORE, WIDE = "decimal(20,6)", "decimal(20,10)", "decimal(8,5)", "decimal(5,4)", "decimal(30,13)"


def dec(value: str | float | int, kind: str = MONEY) -> Column:
    return F.lit(str(value)).cast(kind)


def to_sale(jpy: Column, rate: Column) -> Column:
    """Yen to the sale currency, six places, half up."""
    return F.round(jpy.cast(MONEY) / rate.cast(RATE), 6).cast(WIDE)


def percent(amount: Column, rate: Column) -> Column:
    """A constant rate folds into its share, so a row costs one multiplication."""
    share = (rate.cast(PERCENT) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,7)")
    return (amount.cast("decimal(22,6)") * share).cast(WIDE)


def total(amounts: list[Column]) -> Column:
    """A sum whose type stays put, step by step."""
    return reduce(lambda a, b: (a + b.cast(WIDE)).cast(WIDE), amounts[1:], amounts[0].cast(WIDE))


def convert(df: DataFrame, amount: str, rate: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Converted rows, and rows without a positive rate."""
    good = F.coalesce(F.col(rate) > 0, F.lit(False))
    return df.where(good).withColumn(out, (F.col(amount).cast(MONEY) * F.col(rate).cast(RATE)).cast(WIDE)), df.where(~good)
