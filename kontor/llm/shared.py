"""Small things that every text operator needs."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoints have a home: the cluster's shared folder; a fresh one where none is set and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder that survives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder from the store that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chosen_share(share: Column, id_col: str = "id") -> Column:
    """Whether the row's id falls into a share (0 to 1) of all ids, by a hash with 52 bits: no share of a real table is rounded to nothing."""
    return F.pmod(F.xxhash64(id_col), F.lit(1 << 52)).cast("double") < share * float(1 << 52)


def let_go(spark: SparkSession) -> None:
    """What no variable holds any more leaves the shared folder and the shuffle disks now, not when the driver happens to run out of memory."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


#: Bits of a sieve for each id, and bits at most: its table has MOST_BITS / 64 rows then and can still be broadcast.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _sifted(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column, named by the second value: whether the row's id may be among ``ids``.

    The bitmap of hashed ids has about BITS_PER_ID bits for each id; from MOST_BITS on it gets denser and lets
    more rows through, which costs time and changes nothing else.
    """
    (name,) = ids.columns
    bits = LEAST_BITS
    wanted = min(MOST_BITS, BITS_PER_ID * ids.count())
    while bits < wanted:
        bits *= 2
    slot, word, held, hit = (_free(df, n) for n in ("slot", "word", "held", "hit"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    hashed = ids.select(place(F.col(name)).alias(slot))
    table = hashed.groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias(held))
    own = df.withColumn(slot, place(F.col(id_col))).withColumn(word, F.shiftright(slot, 6))
    may = F.coalesce(F.expr(f"(shiftrightunsigned({held}, cast({slot} & 63 as int)) & 1L) = 1L"), F.lit(False))
    return own.join(F.broadcast(table), word, "left").select(*(F.col(f"`{c}`") for c in df.columns), may.alias(hit)), hit


def sieve(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id may be among ``ids`` (one column): a bitmap of hashed ids, applied where the rows are read.

    It keeps every wanted row and drops most others before a shuffle; an exact join must follow.
    """
    sifted, hit = _sifted(df, id_col, ids)
    return sifted.where(hit).drop(hit)


def without(df: DataFrame, id_col: str, ids: DataFrame, **same: Column) -> DataFrame:
    """The rows of ``df`` whose id is not among ``ids``; only rows that the sieve keeps are shuffled.

    ``ids`` has the id as its first column.  Where an id may stand for several rows, of which not all go, its other
    columns tell them apart: ``same`` has the expression over ``df`` that each of them must equal.
    """
    name = ids.columns[0]
    sifted, hit = _sifted(df, id_col, ids.select(name))
    columns = [F.col(f"`{c}`") for c in df.columns]
    free = {c: _free(df, c) for c in same}
    doubtful = sifted.where(hit).select(*columns, *(same[c].alias(free[c]) for c in same))
    gone = ids.select(F.col(name).alias(id_col), *(F.col(c).alias(free[c]) for c in same))
    doubtful = doubtful.join(gone, [id_col, *free.values()], "left_anti")
    return sifted.where(~F.col(hit)).drop(hit).unionByName(doubtful.select(*columns))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): (id, component), where component is the least id reached.

    Least labels spread along the links and jump to their labels' labels, so the
    number of rounds follows the logarithm of a chain's length, not the length.
    """
    both = settled(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        spread = settled(spread)
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = spread.join(jump, "component").select("id", F.least("component", "far").alias("component"), "before")
        after = settled(after)
        labels = after.select("id", "component")
        if after.where("component <> before").isEmpty():
            return labels
        del near, spread, jump, after
        let_go(links.sparkSession)
