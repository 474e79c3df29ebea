"""Reading listings, names, settings; writing snapshots, histories and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_key

LISTING = (
    "supplier_code string, source_product_id string, canonical_url string, raw_title string, price_incl_tax decimal(20,6), "
    "currency string, stock_qty int, stock_status string, image_urls array<string>, raw_payload string, content_hash string, "
    "fetched_at timestamp"
)


def read_listings(spark: SparkSession, path: str, schema: str = LISTING, kind: str = "parquet") -> DataFrame:
    """Listings with a declared schema; it is never inferred."""
    return spark.read.schema(schema).format(kind).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files; the number is the line's place in its file, counted from 1.

    A large file is read by many tasks.  Lines are counted in each of its splits, the counts are summed along the file (a
    row for each split), and a line's place in its split is added.  Where a file ends with a line break, an empty line follows.
    """
    meta = lambda name: F.col(f"_metadata.{name}")
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", meta("file_path").alias("f"), meta("file_block_start").alias("b"), meta("file_size").alias("s"), F.monotonically_increasing_id().alias("i"))
    # a split is read by one task in one piece, so its lines have numbers in a row
    splits = rows.groupBy("f", "b", "s").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    along = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    placed = splits.select("f", "b", F.col("first").alias("i0"), "before")
    number = F.col("before") + F.col("i") - F.col("i0") + 1
    lines = rows.join(placed, ["f", "b"]).select(number.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))
    ends = splits.groupBy("f", "s").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("bytes = s")
    return lines.unionByName(ends.select((F.col("n") + 1).alias("line_no"), F.lit("").alias("line")))


# Columns of the dictionary of names, and where each comes from by default.
NAMES = {"name_ja": "name_ja", "name_en": "name_en", "set_code": "set_code", "card_number": "card_number", "source": "source", "verified": "is_verified"}


def load_name_catalog(spark: SparkSession, path: str, columns: dict[str, str] = NAMES, kind: str = "parquet") -> DataFrame:
    """The dictionary of names in one read, ready for ``names.resolve_names``: its columns from SQL expressions, and ``name_key``."""
    rows = spark.read.format(kind).load(path).selectExpr(*(f"{expression} AS {name}" for name, expression in columns.items()))
    return rows.withColumn("name_key", comparison_key(F.col("name_ja")))


# Names of the settings, their types and defaults; how the environment may tighten them.
SETTINGS = {
    "dry_run": ("boolean", "true", "or"),
    "allow_production_publish": ("boolean", "false", "and"),
    "max_publish_per_run": ("int", "5", "min"),
    "min_profit_jpy": ("decimal(20,6)", "1500", None),
    "min_margin_percent": ("decimal(8,5)", "15", None),
    "sync_interval_minutes": ("int", "360", None),
    "stock_check_minutes": ("int", "60", None),
    "min_sold_comparables": ("int", "3", None),
    "market_data_max_age_days": ("int", "90", None),
}


def load_settings(kv: DataFrame, env: dict[str, str] | None = None) -> DataFrame:
    """One row of typed settings from (key, value): defaults where absent, and an environment that can only tighten."""
    env = env or {}
    row = kv.where(F.col("key").isin(*SETTINGS)).groupBy().pivot("key", list(SETTINGS)).agg(F.first("value"))
    out: list[Column] = []
    for name, (kind, default, tighten) in SETTINGS.items():
        value = F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind))
        if name in env and tighten:
            given = F.coalesce(F.lit(env[name]).try_cast(kind), F.lit(default).cast(kind))
            value = {"or": value | given, "and": value & given}[tighten] if kind == "boolean" else F.least(value, given)
        out.append(value.alias(name))
    return row.select(*out)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a Parquet history, partitioned by a date where one is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def is_configured(suppliers: DataFrame, selectors: str = "selectors") -> DataFrame:
    """Adds why a supplier is skipped: its selector map is empty or absent."""
    size = F.coalesce(F.size(F.map_keys(selectors)), F.lit(0))
    return suppliers.withColumn("skip_reason", F.when(size <= 0, F.lit("no selectors")))
