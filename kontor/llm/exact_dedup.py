"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Two texts are equal when they are identical after every white-space character
``[\\x20\\x09-\\x0D]`` is deleted.  Of equal texts the row with the most code
points in the original text stays, then the one with the smallest id.

A few contents can make up a large share of the rows, and a shuffle by content
would send each of them to one task.  So:

1. each row is cut down to (id, digest, length) and settled once;
2. a Misra-Gries summary (``approx_top_k``, whose sketch is of that family)
   names the digests that may be frequent; its size is a parameter, so what the
   driver sees is bounded whatever the input;
3. the named digests are counted exactly with a partial aggregate; the verified
   winners are a table of at most ``tracked`` rows and are broadcast, so the
   copies of frequent contents are resolved on the map side;
4. every other digest goes through an ordinary shuffle.  The summary's error
   bound (about rows / (0.75 * tracked)) limits how large such a group can be.

Defined results: a null text is an empty text; empty texts equal each other and
white-space-only texts; rows that repeat an id count as rows of their own with
that id, all kept where it is the one that stays; a row without an id stays only if its
whole group has none of that length; ids may be of any type that can be ordered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled, without

#: Counters of the Misra-Gries summary, and the most contents that are broadcast.
TRACKED = 8192
WINNERS = 2048


def digest(text_col: str) -> Column:
    """SHA-256 of the text without white space."""
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare, 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, length), the last in code points of the text as it is."""
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), length.alias("length"))


def frequent(rows: DataFrame, tracked: int, winners: int) -> DataFrame:
    """The digests that a Misra-Gries summary of ``tracked`` counters finds frequent: ``winners`` rows at most."""
    top = rows.agg(F.expr(f"approx_top_k(hex(digest), {winners}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("top")).where("top.count > 1").select(F.unhex("top.item").alias("digest"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, winners: int = WINNERS
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = settled(digests(docs, id_col, text_col))
    best = F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("nameless"), F.col("id").alias("keep_id"))
    named = frequent(rows, tracked, winners)
    heavy = (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    heavy = settled(heavy.select("digest", "best.keep_id", "group_size"))
    of_heavy = rows.join(F.broadcast(heavy), "digest")
    per_digest = Window.partitionBy("digest")
    others = (
        rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("best", F.min(best).over(per_digest))
        .withColumn("group_size", F.count(F.lit(1)).over(per_digest))
        .withColumn("keep_id", F.col("best.keep_id"))
    )
    columns = [
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return of_heavy.select(*columns).unionByName(others.select(*columns))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; the columns stay.

    Of rows with one id and different texts only those go whose text stays under another id.
    """
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    gone = gone.select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    return without(docs, id_col, settled(gone), digest=digest(text_col))
