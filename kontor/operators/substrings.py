"""Search for a part of a name through an index of character triples.

A scan with ``ILIKE`` reads all names for each question.  The index is written once: a row for each triple of characters
and name that has it, in partitions by triple, and the number of names of each triple.  A question reads the rows of its
own rarest triples, intersects them, and tests ``ILIKE`` on what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import search_names

#: Partitions of the index, and triples of a question that are read.
BUCKETS, READ = 16, 4
#: Names that one task of ``build`` cuts into triples, whatever the size of their files.
ROWS = 10_000


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a pattern."""
    parts, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            at += 1
            parts[-1] += pattern[at]
        elif pattern[at] in "%_":
            parts.append("")
        else:
            parts[-1] += pattern[at]
        at += 1
    return [p for p in parts if p]


def triples(pattern: str) -> list[str]:
    """The triples that any match of the pattern has; letters whose lower case is of another length are left to the test."""
    out = set()
    for part in literal_parts(pattern):
        low = part.lower() if all(len(c.lower()) == 1 for c in part) else ""
        out |= {low[i : i + 3] for i in range(len(low) - 2)}
    return sorted(out)


@dataclass(frozen=True)
class NameIndex:
    """An index at ``path`` of the names in ``columns``, which ``id`` tells apart."""

    path: str
    id: str = "id"
    columns: tuple[str, ...] = ("name_ja", "name_en")

    def build(self, names: DataFrame) -> None:
        names = names.where(F.col(self.id).isNotNull()).select(self.id, *self.columns)
        parts = names.count() // ROWS + 1
        text = F.explode(F.array(*(F.lower(c) for c in self.columns))).alias("t")
        rows = names.repartition(parts, self.id).select(self.id, text).where(F.length("t") >= 3)
        at = F.sequence(F.lit(1), F.length("t") - 2)
        rows = rows.select(self.id, F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("t", i, F.lit(3))))).alias("triple")).distinct()
        rows = rows.withColumn("bucket", self._bucket())
        rows.repartitionByRange(parts, "bucket", "triple", self.id).sortWithinPartitions("bucket", "triple").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = names.sparkSession.read.parquet(f"{self.path}/postings").groupBy("bucket", "triple").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("bucket", "triple").sortWithinPartitions("bucket", "triple").write.partitionBy("bucket").parquet(f"{self.path}/counts")

    def _bucket(self):
        return F.pmod(F.xxhash64("triple"), F.lit(BUCKETS)).cast("int")

    def _of(self, spark: SparkSession, name: str, wanted: list[str]) -> DataFrame:
        """Rows of the wanted triples; other partitions are not read."""
        given = spark.createDataFrame([(t,) for t in wanted], "triple string").select(self._bucket().alias("b")).distinct()
        buckets = [r.b for r in given.collect()]
        return spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets) & F.col("triple").isin(wanted))

    def search(self, names: DataFrame, pattern: str | None) -> DataFrame:
        """``reports.search_names`` by the index; a pattern without three letters in a row is a scan, as is none."""
        wanted = triples(pattern) if pattern is not None else []
        if not wanted:
            return search_names(names, pattern)
        spark = names.sparkSession
        counts = self._of(spark, "counts", wanted).orderBy("n", "triple").select("triple").limit(len(wanted)).collect()
        if len(counts) < len(wanted):
            return names.limit(0)  # a triple that no name has
        rarest = [r.triple for r in counts[:READ]]
        found = self._of(spark, "postings", rarest).groupBy(self.id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(rarest))
        return search_names(names.join(found.select(self.id), self.id, "left_semi"), pattern)
