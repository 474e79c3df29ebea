"""The index of character triples against the scan."""

import random

from pyspark.sql import functions as F

from kontor.operators import substrings
from kontor.operators.reports import search_names
from kontor.operators.substrings import NameIndex, literal_parts, triples


def test_parts_and_triples():
    assert literal_parts(r"%ab\%c_de%") == ["ab%c", "de"] and triples("%ABcd%xy%") == ["abc", "bcd"] and triples("%ab%") == [] and triples("") == []
    assert triples("%İstanbul%") == []  # its small letter is two characters


def test_equals_the_scan(spark, tmp_path, capsys):
    pick = random.Random(8)
    words = ["リザードンex", "Charizard", "charcoal", "Pika chu", "100%", "a_b", "x", "", None, "MEWTWO", "aaaaaa", "ピカチュウ"]
    rows = [(i, *(None if (w := pick.choice(words)) is None else w + pick.choice(["", " " + (pick.choice(words) or "")]) for _ in range(2))) for i in range(600)] + [(None, "Charizard", "x")]
    names = spark.createDataFrame(rows, "id int, name_ja string, name_en string").repartition(4)
    index = NameIndex(str(tmp_path / "index"))
    index.build(names)
    known = names.where("id is not null")
    for pattern in ("%char%", "%CHAR%co%", "charizard", "%ザードン%", "%ar%", "%", "%nothing%", r"%100\%%", "%a_b%", "%aaaa%", "%chu pika%", "c_arizard%", None):
        got, want = (sorted(map(tuple, df.collect()), key=str) for df in (index.search(known, pattern), search_names(known, pattern)))
        assert got == want, pattern
    index.search(known, "%charizard%").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [In(triple" in plan or "In(triple" in plan


def test_build_is_dealt_out_by_names_and_not_by_bytes(spark, tmp_path, monkeypatch):
    """Names from a file of one split, where Spark has one partition for them."""
    monkeypatch.setattr(substrings, "ROWS", 100, raising=False)
    names = spark.range(1000).coalesce(1).selectExpr("id", "concat('name ', id) as name_ja", "'Charizard' as name_en")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = NameIndex(str(tmp_path / "index"))
        index.build(names)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    written = spark.read.parquet(f"{index.path}/postings").groupBy(F.input_file_name().alias("file")).count().collect()
    assert max(r["count"] for r in written) < sum(r["count"] for r in written) / 5
    assert index.search(names, "%arizar%").count() == 1000 and index.search(names, "%ame 99%").count() == 11
