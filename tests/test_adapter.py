"""Suppliers' pages as a data source: configuration, partitions, filters, streams."""

import json

import pytest
from pyspark.sql import functions as F

from kontor.sources import adapter

A = '<ul><li class="c"><a href="/p/1?id=7">One <b>1</b></a></li><li class="c"><a href="/p/2">Two</a></li><li class="c"><i>no link</i></li></ul>'
B = '<table><tr data-key="k9"><td>Nine</td></tr><tr><td>None</td></tr></table>'
CONFIG = [
    {"supplier": "a", "card": {"tag": "li", "cls": "c"}, "fields": {"name": {"tag": "a", "required": True}, "link": {"tag": "a", "attribute": "href"}}, "ids": [["query", "id"], ["path", "/p/([0-9]+)"]]},
    {"supplier": "b c", "card": {"css": "table tr"}, "fields": {"name": {"tag": "td"}, "key": {"css": "tr[data-key]", "attribute": "data-key"}}, "ids": [["field", "key"]]},
]


@pytest.fixture
def folder(spark, tmp_path):
    path = f"{tmp_path}/pages"
    adapter.register(spark)
    for page, supplier, html in ((1, "a", A), (2, "a", None), (3, "a", ""), (4, "b c", B), (5, "unknown", A), (6, "a", A)):
        spark.createDataFrame([(page, "https://s.jp/x/", html, supplier)], "page_id long, url string, html string, supplier string").write.mode("append").partitionBy("supplier").parquet(path)
    return path


def load(spark, folder, config=CONFIG):
    return spark.read.format(adapter.NAME).option("path", folder).option("suppliers", json.dumps(config)).load()


def rows(df):
    return sorted((r.supplier, r.page_id, r.position, r.source_id, r.url, r.fields.get("name"), tuple(r.missing_required)) for r in df.collect())


OF_A = [(0, "7", "https://s.jp/p/1?id=7", "One 1", ()), (1, "2", "https://s.jp/p/2", "Two", ()), (2, None, None, None, ("name",))]
WANT = [("a", p, *r) for p in (1, 6) for r in OF_A] + [("b c", 4, 0, "k9", None, "Nine", ()), ("b c", 4, 1, None, None, "None", ())]


def test_two_suppliers_by_configuration(spark, folder):
    df = load(spark, folder)
    got = sorted((*r,) for r in rows(df))
    assert sorted(got, key=str) == sorted(WANT, key=str)
    assert df.rdd.getNumPartitions() == 5  # a task for each file of a configured supplier


def test_a_filter_chooses_files(spark, folder, capsys):
    one = load(spark, folder).where("supplier = 'b c' and position >= 1")
    assert rows(one) == [WANT[-1]] and one.rdd.getNumPartitions() == 1
    some = load(spark, folder).where(F.col("supplier").isin("b c", "unknown"))
    assert some.count() == 2 and some.rdd.getNumPartitions() == 1
    assert load(spark, folder).where("supplier = 'nobody'").count() == 0
    reader = adapter.PagesReader({"path": folder, "suppliers": json.dumps(CONFIG)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = [GreaterThan(("position",), 0)]
    assert list(reader.pushFilters([EqualTo(("supplier",), "a"), *rest])) == rest and reader.names == {"a"}


def test_bad_configuration_and_empty_folders(spark, tmp_path, folder):
    assert load(spark, f"{tmp_path}/nothing").count() == 0
    with pytest.raises(Exception, match="unknown strategy"):
        load(spark, folder, [CONFIG[0] | {"ids": [["tea", "leaves"]]}]).collect()


def test_stream_takes_new_files_once(spark, folder, tmp_path):
    def run():
        df = spark.readStream.format(adapter.NAME).option("path", folder).option("suppliers", json.dumps(CONFIG)).load()
        query = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/out")

    assert run().count() == len(WANT)
    spark.createDataFrame([(9, "https://s.jp/", B, "b c")], "page_id long, url string, html string, supplier string").write.mode("append").partitionBy("supplier").parquet(folder)
    assert sorted(rows(run()), key=str) == sorted(WANT + [("b c", 9, *r[2:]) for r in WANT[-2:]], key=str)
    assert run().count() == len(WANT) + 2
