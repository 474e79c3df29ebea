"""Work along the order of a key's rows when one key may hold any share of them.

A window over a key sorts that key in one task.  Here rows are dealt by ranges of (key, order), so a frequent key is
spread over many partitions; each partition works along its own part of a key, and what the next part needs of it, one
row for each key that a boundary cuts, is handed on in a second, small step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import settled

PART = "_part"


def dealt(df: DataFrame, key: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` in ranges of (key, order), with the number of the range; written down, so the ranges stay what they are."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in key), *order)
    return settled(ranged.withColumn(PART, F.spark_partition_id()))


def handed_on(rows: DataFrame, key: Sequence[str], order: Sequence[Column], carried: Column, name: str, where: Column | None = None) -> DataFrame:
    """(key, range, ``name``): the last ``carried`` of the key in the ranges before; only for keys that a boundary cuts.

    Each boundary cuts one key at most, so these are no more rows than ranges.
    """
    best = F.max_by(carried, F.struct(*order)) if where is None else F.max_by(F.when(where, carried), F.when(where, F.struct(*order)))
    ends = rows.groupBy(*key, PART).agg(best.alias("_last"))
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn(name, F.last("_last", ignorenulls=True).over(before)).where(F.col(name).isNotNull()).drop("_last")


def _with(rows: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    """A left join by key and range in which null keys meet; ``more`` has a row for each range at most."""
    named = more.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate((*key, PART))), *(c for c in more.columns if c not in (*key, PART)))
    on = F.lit(True)
    for i, c in enumerate((*key, PART)):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(named), on, "left").drop(*(f"_k{i}" for i in range(len(key) + 1)))


def previous_value(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``value`` of the key's row before; ``order`` must tell a key's rows apart.  Equal to ``lag`` over the key."""
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = dealt(df, key, by, parts)
    held = F.struct(F.col(value).alias("v"))  # so that a null value is handed on as well
    cut = handed_on(rows, key, [F.col(c) for c in order], held, "_handed")
    own = Window.partitionBy(*key, PART).orderBy(*by)
    rows = rows.withColumn("_own", F.lag(held).over(own))
    return _with(rows, cut, key).withColumn(name, F.coalesce("_own", "_handed")["v"]).drop("_own", "_handed", PART)


def as_of_join(
    facts: DataFrame, profiles: DataFrame, key: Sequence[str], at: str, since: str, best: Sequence[Column] = (), parts: int | None = None
) -> DataFrame:
    """Each fact with the profile of its key that is in force at its time: the last with ``since`` not after ``at``.

    Of profiles of one key and time the first in the order ``best`` (columns of the profile) counts.  Facts without one
    have nulls; a null key matches nothing.  Both sides are laid in one order and the last profile is carried along it,
    so neither side is broadcast or collected, whatever its size.
    """
    fields = [c for c in profiles.columns if c not in key]
    theirs = profiles.where(" and ".join(f"`{c}` is not null" for c in (*key, since))).select(
        *key, F.col(since).alias("_time"), F.lit(0).alias("_kind"), F.struct(*(b.alias(f"b{i}") for i, b in enumerate(best)), F.lit(0).alias("b")).alias("_best"),
        F.struct(*fields).alias("_profile"),
    )
    # of equal times only the best profile is laid out
    theirs = theirs.groupBy(*key, "_time", "_kind").agg(F.min_by("_profile", "_best").alias("_profile"))
    mine = facts.select(*key, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    both = theirs.unionByName(mine, allowMissingColumns=True)
    by = [F.col("_time").asc_nulls_first(), F.col("_kind").asc()]
    rows = dealt(both, key, by, parts)
    cut = handed_on(rows, key, [F.col("_time")], F.col("_profile"), "_handed", F.col("_kind") == 0)
    own = Window.partitionBy(*key, PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.last("_profile", ignorenulls=True).over(own)).where(F.col("_kind") == 1)
    found = _with(rows, cut, key).withColumn("_found", F.when(F.col("_time").isNotNull(), F.coalesce("_own", "_handed")))
    return found.select("_fact.*", *(F.col(f"_found.{c}").alias(c) for c in fields))
