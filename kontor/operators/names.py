"""The dictionary of card names: import, and resolution in tiers without falling through an ambiguous one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparison_key
from .attributes import capped

# Tier, precision, confidence.
TIERS = ((1, "EXACT", 1.0), (2, "NAME_AND_NUMBER", 0.95), (3, "NAME_ONLY", 0.7))


def resolve_names(listings: DataFrame, names: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """precision, name_en, confidence, n_candidates for each listing (id, name_ja, set_code, card_number).

    At the best tier with an entry: one English name is taken, several are AMBIGUOUS and give none.  Entries are
    combined for each (key, tier) before they meet a listing, so a name with many entries multiplies nothing.
    """
    queries = listings.select(
        id_col,
        comparison_key(F.col("name_ja")).alias("key"),
        comparison_key(F.col("set_code")).alias("set"),
        comparison_key(F.col("card_number")).alias("number"),
    )
    entries = names.select(
        comparison_key(F.col("name_ja")).alias("key"),
        comparison_key(F.col("set_code")).alias("set"),
        comparison_key(F.col("card_number")).alias("number"),
        "name_en", "verified", "source",
    )
    best = F.min(F.struct((~F.col("verified")).alias("u"), "source", "name_en", "verified"))

    def level(*by: str) -> DataFrame:
        known = entries
        for c in by[1:]:
            known = known.where(F.col(c).isNotNull() & (F.col(c) != ""))
        return known.groupBy(*by).agg(
            F.count_distinct("name_en").alias("n_names"), F.count(F.lit(1)).alias("n_candidates"), best.alias("best")
        )

    out = queries
    for (tier, _, _), by in zip(TIERS, (("key", "set", "number"), ("key", "number"), ("key",)), strict=True):
        own = level(*by).select(*by, F.struct("n_names", "n_candidates", "best").alias(f"t{tier}"))
        out = out.join(own, list(by), "left")
    hit = F.coalesce("t1", "t2", "t3")
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    out = out.withColumns({"tier": tier, "hit": hit})
    one = F.col("hit.n_names") == 1
    precision = F.when(F.col("tier").isNull(), "NOT_FOUND").when(~one, "AMBIGUOUS")
    confidence = F.lit(0.0)
    for n, name, sure in TIERS:
        precision = precision.when(F.col("tier") == n, name)
        confidence = F.when(F.col("tier") == n, F.lit(sure)).otherwise(confidence)
    sure = F.when(one, capped(confidence, F.col("hit.best.verified"))).otherwise(0.0)
    return out.select(
        id_col,
        precision.alias("precision"),
        F.when(one, F.col("hit.best.name_en")).alias("name_en"),
        sure.alias("confidence"),
        F.coalesce(F.when(~one, F.col("hit.n_candidates")), F.lit(0)).alias("n_candidates"),
    )


def import_names(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows, rejected lines, one row of counts) from (line_no, line): name_ja, name_en, set_code, card_number.

    A tab separates fields, else a comma; a line without either name is rejected with its number.
    """
    sep = F.when(F.col("line").contains("\t"), F.lit("\t")).otherwise(",")
    cells = F.transform(F.split(F.col("line"), sep), lambda c: F.trim(c))
    rows = lines.where(F.trim("line") != "").withColumn("c", cells)
    rows = rows.select(
        "line_no", "line",
        *(F.nullif(F.coalesce(F.get("c", F.lit(i)), F.lit("")), F.lit("")).alias(n) for i, n in enumerate(("name_ja", "name_en", "set_code", "card_number"))),
    )
    good = F.col("name_ja").isNotNull() & F.col("name_en").isNotNull()
    rejected = rows.where(~good).select("line_no", "line")
    valid = rows.where(good).withColumn("name_key", comparison_key(F.col("name_ja"))).withColumn("verified", F.lit(False))
    added = insert_ignore(known, valid.drop("line"), "line_no")
    counts = valid.agg(F.count(F.lit(1)).alias("valid")).crossJoin(added.agg(F.count(F.lit(1)).alias("inserted")))
    counts = counts.crossJoin(rejected.agg(F.count(F.lit(1)).alias("rejected")))
    return added, rejected, counts.withColumn("duplicates", F.col("valid") - F.col("inserted"))


def insert_ignore(known: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Rows that no unique key forbids: the full key, or the name alone; a row with one of set and number is always new."""
    full, bare = ["name_key", "set_code", "card_number"], ["name_key"]
    is_full = F.col("set_code").isNotNull() & F.col("card_number").isNotNull()
    is_bare = F.col("set_code").isNull() & F.col("card_number").isNull()

    def first(df: DataFrame, key: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*df.columns)

    new_full = first(rows.where(is_full), full).join(known.where(is_full).select(*full), full, "left_anti")
    new_bare = first(rows.where(is_bare), bare).join(known.where(is_bare).select(*bare), bare, "left_anti")
    return new_full.unionByName(new_bare).unionByName(rows.where(~is_full & ~is_bare))


