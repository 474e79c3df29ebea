"""Snapshots of listings: what changed, what vanished, upserts, histories and moves, and rows that break the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, reasons
from .ordered import previous_value

KEY = ("supplier_id", "source_product_id")


def content_hash(*parts: Column, length: int = 32) -> Column:
    """Hash of the meaningful content, for change detection; a null differs from an empty text."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256), 1, length)


def one_per_key(df: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The last delivered row of each key: by ``fetched_at`` where there is one, then by the other columns, so that it is the same row every time."""
    rest = [c for c in df.columns if c not in key]
    return latest(df, list(key), sorted(rest, key=lambda c: (c != "fetched_at", c)))


def diff_listings(current: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key of either side: status and change flags; prices compare as decimals.

    Columns read on both sides: the key, content_hash, price, stock_status, stock_qty; of the incoming side also
    fetched_at and verdict where it has them.  A rejected listing is ``skipped``: seen, but nothing about it changes.
    """
    compared = ("content_hash", "price", "stock_status", "stock_qty")
    old = current.select(*key, *(F.col(c).alias(f"old_{c}") for c in compared), F.lit(True).alias("_old"))
    verdict = F.col("verdict") if "verdict" in incoming.columns else F.lit(None).cast("string").alias("verdict")
    new = one_per_key(incoming, key).select(*key, *compared, verdict, F.lit(True).alias("_new"))
    df = old.join(new, list(key), "full_outer")
    status = (
        F.when(F.col("_new").isNull(), "unseen")
        .when(F.col("verdict") == "REJECTED", "skipped")
        .when(F.col("_old").isNull(), "created")
        .when(F.col("content_hash").eqNullSafe(F.col("old_content_hash")), "unchanged")
        .otherwise("updated")
    )
    changed = F.col("status") == "updated"
    price = F.col("price").cast("decimal(20,6)").eqNullSafe(F.col("old_price").cast("decimal(20,6)"))
    stock = F.col("stock_status").eqNullSafe(F.col("old_stock_status")) & F.col("stock_qty").eqNullSafe(F.col("old_stock_qty"))
    df = df.withColumn("status", status)
    return df.withColumns({"price_changed": changed & ~price, "stock_changed": changed & ~stock}).drop("_old", "_new")


def vanished(current: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Live keys of suppliers that delivered something, which were not delivered; a silent supplier loses nothing."""
    seen = incoming.select(key[0]).distinct()
    live = current.where("disappeared_at is null") if "disappeared_at" in current.columns else current
    return live.join(seen, key[0], "left_semi").join(incoming.select(*key), list(key), "left_anti")


def sync_stats(diff: DataFrame, by: str = KEY[0]) -> DataFrame:
    """Counts of a synchronisation for each supplier; a new listing brings a first price and a first stock."""
    n, is_ = F.count_if, lambda s: F.col("status") == s
    seen = F.col("status") != "unseen"
    return diff.groupBy(by).agg(
        n(seen).alias("seen"),
        *(n(is_(s)).alias(s) for s in ("created", "updated", "unchanged", "unseen", "skipped")),
        *(n(seen & (F.col("verdict") == v)).alias(v.lower()) for v in ("CONFIRMED", "REVIEW", "REJECTED")),
        n(is_("created") | F.col("price_changed")).alias("price_changes"),
        n(is_("created") | F.col("stock_changed")).alias("stock_changes"),
    )


def upsert_listings(current: DataFrame, incoming: DataFrame, at: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """The next snapshot: incoming rows replace or join current ones and are live again; vanished ones are marked once.

    Of several rows of a key the last one counts (``one_per_key``); a rejected row is not stored, but what is known
    under its key has not vanished.  Running it again with the same incoming rows changes nothing.
    """
    incoming = one_per_key(incoming, key)
    stored = F.coalesce(F.col("verdict") != "REJECTED", F.lit(True)) if "verdict" in incoming.columns else F.lit(True)
    fields = [c for c in incoming.columns if c not in key]
    new = incoming.select(*key, *(F.col(c).alias(f"_n_{c}") for c in fields), stored.alias("_stored"))
    delivered = incoming.select(key[0]).distinct().withColumn("_delivered", F.lit(True))
    df = current.withColumn("_old", F.lit(True)).join(new, list(key), "full_outer").join(delivered, key[0], "left")
    df = df.where(F.col("_old") | F.col("_stored"))
    gone = F.col("_stored").isNull() & F.coalesce("_delivered", F.lit(False))
    out = {c: F.when(F.col("_stored"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields if c in current.columns}
    out["disappeared_at"] = F.when(F.col("_stored"), None).when(gone, F.coalesce("disappeared_at", at)).otherwise(F.col("disappeared_at"))
    out["stock_status"] = F.when(gone & F.col("disappeared_at").isNull(), "OUT_OF_STOCK").otherwise(out["stock_status"])
    return df.select(*key, *(out.get(c, F.col(c)).alias(c) for c in current.columns if c not in key))


def history_rows(diff: DataFrame, at: Column, key: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the price and the stock history: only what is new or changed."""
    new = F.col("status") == "created"
    stamp = [at.alias("observed_at"), F.to_date(at).alias("obs_date")]
    prices = diff.where(new | F.col("price_changed")).select(*key, "price", *stamp)
    stocks = diff.where(new | F.col("stock_changed")).select(*key, "stock_status", "stock_qty", *stamp)
    return prices, stocks


def price_moves(history: DataFrame, key: str, at: list[str], price: str, spread: bool = False) -> DataFrame:
    """Rows of a history at which the price differs from the one before.

    A window sorts a key in one task.  ``spread`` deals the rows by ranges of key and time instead, for histories in which
    a key may hold a large share of all rows; ``at`` must then tell a key's rows apart.
    """
    if spread:
        rows = previous_value(history, [key], at, price, "previous")
    else:
        rows = history.withColumn("previous", F.lag(price).over(Window.partitionBy(key).orderBy(*at)))
    return rows.where(~F.col(price).eqNullSafe(F.col("previous")) & F.col("previous").isNotNull())


def recent_history(history: DataFrame, key: str, order: list[Column], n: int = 20) -> DataFrame:
    """The last ``n`` rows of each listing."""
    return history.withColumn("recency", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("recency") <= n)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by a combined maximum rather than a sort."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def quality_gate(df: DataFrame, rules: list[Rule], unique: dict[str, tuple[list[str], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``reasons``).

    ``unique`` names keys that may occur once among the rows of a condition: name -> (columns, condition).  Keys are
    counted by a partial aggregate and joined back, so a frequent key is split by Spark and not sorted in one task.
    """
    marked = df.withColumn("reasons", reasons(rules))
    for name, (columns, where) in (unique or {}).items():
        twice = df.where(where).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        twice = twice.select(*(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_twice"))
        match = F.lit(True)
        for c in columns:
            match = match & (F.col(c) == F.col(f"_{c}"))
        marked = marked.join(twice, match, "left")
        broken = F.coalesce("_twice", F.lit(False)) & F.coalesce(where, F.lit(False))
        marked = marked.withColumn("reasons", F.when(broken, F.concat("reasons", F.array(F.lit(name)))).otherwise(F.col("reasons")))
        marked = marked.drop("_twice", *(f"_{c}" for c in columns))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def listing_rules() -> list[Rule]:
    """Rules for supplier listings."""
    c = F.col
    return [
        Rule("price_not_negative", c("price").isNull() | (c("price") >= 0)),
        Rule("stock_not_negative", c("stock_qty").isNull() | (c("stock_qty") >= 0)),
        Rule("confidence_in_range", c("confidence").isNull() | c("confidence").between(0, 1)),
    ]


def attribute_rules() -> list[Rule]:
    """Rules for attributes with provenance."""
    c = F.col
    return [
        Rule("confidence_in_range", c("confidence").between(0, 1)),
        Rule("unknown_has_no_value", (c("source") != "unknown") | c("value").isNull()),
        Rule("no_value_no_confidence", c("value").isNotNull() | (c("confidence") == 0)),
    ]


def market_rules() -> list[Rule]:
    """Rules for published listings, images, matches, observations and dictionary rows."""
    c = F.col
    return [
        Rule("quantity_not_negative", c("quantity") >= 0),
        Rule("published_is_complete", (c("status") != "PUBLISHED") | (c("price").isNotNull() & c("currency").isNotNull() & c("title").isNotNull())),
        Rule("title_fits", c("title").isNull() | (F.length("title") <= 80)),
        Rule("redaction_approved_by_human", ~(c("redacted") & c("approved")) | c("approved_at").isNotNull()),
        Rule("score_in_range", c("score").isNull() | c("score").between(0, 1)),
        Rule("max_not_below_min", c("active_max").isNull() | c("active_min").isNull() | (c("active_max") >= c("active_min"))),
        Rule("name_not_blank", (F.trim("name_en") != "") & (F.trim("name_key") != "")),
        Rule("verified_has_author", ~c("verified") | c("verified_by").isNotNull()),
    ]


def processing_rules() -> list[Rule]:
    """Rules for what was made of an image."""
    c = F.col("processing_confidence")
    return [Rule("processing_confidence_in_range", c.isNull() | c.between(0, 1))]
