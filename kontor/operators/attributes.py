"""Attributes with provenance: trust, reliability, the long and the wide form, parsed titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# How far a source is trusted.
TRUST = {
    "manual": 100, "structured_data": 90, "supplier_rule": 80, "catalog_lookup": 70,
    "title_parser": 60, "ai_extraction": 40, "ai_inference": 10, "unknown": 0,
}
SPECULATIVE = ("ai_inference", "unknown")
UNVERIFIED = 0.6


def trust(source: Column) -> Column:
    return F.coalesce(*(F.when(source == s, F.lit(t)) for s, t in TRUST.items()), F.lit(0))


def reliability(df: DataFrame, least: float = 0.85) -> DataFrame:
    """Adds is_known, is_speculative, is_reliable; columns read: value, source, confidence."""
    known = F.col("value").isNotNull() & (F.col("source") != "unknown")
    guess = F.col("source").isin(*SPECULATIVE)
    return df.withColumns(
        {"is_known": known, "is_speculative": guess, "is_reliable": known & ~guess & (F.col("confidence") >= least)}
    )


def capped(confidence: Column, verified: Column) -> Column:
    """The confidence of a row nobody verified is capped."""
    return F.when(verified, confidence).otherwise(F.least(confidence, F.lit(UNVERIFIED)))


def prefer_trust(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The attribute of each key from the most trusted source; then by confidence; then the earliest."""
    order = F.struct(trust(F.col("source")), F.col("confidence"), -F.col(seq))
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def aggregate_confidence(df: DataFrame, key: list[str]) -> DataFrame:
    """The least confidence of a listing's fields."""
    return df.groupBy(*key).agg(F.min("confidence").alias("confidence"))


def parse_titles(df: DataFrame, title: str = "title", fields: dict[str, Column] | None = None) -> DataFrame:
    """Adds a struct for each attribute, ``warnings`` and the overall confidence."""
    fields = fields or text.attributes(F.col(title))
    df = df.withColumns(fields)
    grade = F.col("grade.value").try_cast("decimal(3,1)")
    warnings = F.array(
        F.when(F.col("card_number.value").isNull(), F.lit("MISSING_CARD_NUMBER")),
        F.when(F.col("card_name.value").isNull(), F.lit("MISSING_CARD_NAME")),
        F.when(F.col("language.value").isNull(), F.lit("UNKNOWN_LANGUAGE")),
        F.when(grade.isNotNull() & (grade != 10), F.lit("NOT_GRADE_10")),
    )
    overall = F.least(*(F.col(f"{f}.confidence") for f in text.GATING))
    return df.withColumns({"warnings": F.filter(warnings, lambda w: w.isNotNull()), "overall_confidence": overall})


def to_long(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per field: field, value, source, confidence, note."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("a")) for f in fields))
    return df.select(*key, F.inline(rows)).select(*key, "field", "a.value", "a.source", "a.confidence", "a.note")


def to_wide(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The values as columns, one row per key."""
    return df.groupBy(*key).pivot("field", fields).agg(F.first("value"))
