import json
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kontor.functions.rules import first_match
from kontor.operators import audit, publishing
from kontor.sources import listings as src
from kontor.sources import metadata, pages
from kontor.streaming import listings as streams

SF = "/root/testdata/sf0.001"
PAGE = """<ul><li class="item card"><a href="/p/100234"><span class="name">【PSA10】リザードンex SAR 201/165</span></a><b class="price">¥128,000(税込)</b><i class="stock">残り 2 点</i></li>
<li class="item card"><a href="/p/100236"><span class="name">ピカチュウ</span><img src=x></a><b class="price">￥8,500</b><i class="stock">SOLD OUT</i></li></ul>
<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{bad</script>"""


def test_cards_and_structured_data(spark):
    df = spark.createDataFrame([(1, "https://shop.jp/c?page=1", PAGE), (2, "https://shop.jp/e", None)], "page_id long, url string, html string")
    config = pages.CardConfig(
        pages.Selector("li", "card"),
        {"name": pages.Selector(cls="name"), "link": pages.Selector("a", attribute="href"), "price": pages.Selector(cls="price"), "stock": pages.Selector(cls="stock"), "seller": pages.Selector(cls="seller")},
    )
    cards = pages.extract_listing_cards(df, config).withColumn("s", first_match(F.col("stock"), [("残り\\s*([0-9]+)", "IN_STOCK", 1), ("SOLD", "OUT_OF_STOCK", None)]))
    got = [(r.name, r.link, r.price_value, r.s.status, r.s.quantity) for r in cards.orderBy("position").collect()]
    assert got == [("【PSA10】リザードンex SAR 201/165", "/p/100234", Decimal(128000), "IN_STOCK", 2), ("ピカチュウ", "/p/100236", Decimal(8500), "OUT_OF_STOCK", None)]
    ids = pages.source_ids(cards.withColumn("url", F.concat(F.lit("https://shop.jp"), "link")), [("query", "id"), ("path", "/p/([0-9]+)")])
    assert {r.source_id for r in ids.collect()} == {"100234", "100236"}
    health = pages.adapter_health(cards, "page_id", ["name", "seller"]).first()
    assert (health.hits_name, health.missing, health.healthy) == (2, ["seller"], False)
    ld = pages.extract_json_ld(df).orderBy("position").collect()
    assert [(r.type, r.parses) for r in ld] == [("Product", True), (None, False)]
    top = pages.discover_card_classes(df, least=2).collect()
    assert {r["class"] for r in top} == {"item", "card"}


def test_settings_only_tighten(spark):
    kv = spark.createDataFrame([("dry_run", "false"), ("max_publish_per_run", "9"), ("min_profit_jpy", "oops")], "key string, value string")
    r = src.load_settings(kv, {"dry_run": "true", "allow_production_publish": "true", "max_publish_per_run": "3"}).first()
    assert (r.dry_run, r.allow_production_publish, r.max_publish_per_run, r.min_profit_jpy) == (True, False, 3, 1500)
    assert src.load_settings(kv.where("false")).first().dry_run is True


def test_lines_and_histories(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a,b\n\nc\td\n")
    assert sorted(tuple(r) for r in src.read_lines(spark, str(tmp_path / "names.txt")).collect()) == [(1, "a,b"), (2, ""), (3, "c\td"), (4, "")]
    df = spark.createDataFrame([(1, "2024-01-01")], "id int, obs_date string")
    src.append(df, str(tmp_path / "h"), "obs_date")
    src.append(df, str(tmp_path / "h"), "obs_date")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


POLICY = {
    "itemConditionPolicies": [
        {"categoryId": "1", "itemConditions": [
            {"conditionId": "9", "conditionDescriptors": []},
            {"conditionId": "2750", "conditionDescriptors": [
                {"name": "Professional Grader", "conditionDescriptorId": "27501", "values": [{"conditionDescriptorValueId": "p", "conditionDescriptorValueName": "PSA"}]},
                {"name": "Grade", "conditionDescriptorId": "27502", "values": [{"conditionDescriptorValueId": "g10", "conditionDescriptorValueName": "Gem 10"}, {"conditionDescriptorValueId": "g95", "conditionDescriptorValueName": "9.5"}]}]}]},
        {"categoryId": "2", "itemConditions": [{"conditionId": "9", "conditionDescriptors": []}]},
    ]
}


def test_policies(spark):
    flat = metadata.flatten_condition_policies(spark.createDataFrame([(json.dumps(POLICY),)], "payload string"))
    want = [("a", "1", "psa", "10.0"), ("b", "1", "PSA", "9.5"), ("c", "1", "BGS", "10.0"), ("d", "1", "PSA", "8.0"), ("e", "2", "PSA", "10.0"), ("f", "3", "PSA", "10.0")]
    own = spark.createDataFrame([(i, c, g, Decimal(v)) for i, c, g, v in want], "listing_id string, category_id string, grading_company string, grade decimal(3,1)")
    got = {r.listing_id: (r.grade_value_id, r.failure) for r in publishing.resolve_descriptors(own, flat).collect()}
    assert got == {"a": ("g10", None), "b": ("g95", None), "c": ("g10", "company not offered"), "d": (None, "grade not offered"), "e": (None, "no graded condition"), "f": (None, "no policy for the category")}
    doc = {"aspects": [{"localizedAspectName": "Game", "aspectConstraint": {"aspectRequired": True}, "aspectValues": [{"localizedValue": "P"}, {"localizedValue": ""}]}, {"aspectConstraint": {}}, {"localizedAspectName": "Note"}]}
    aspects = {r.name: (r.required, r.selection_only, r["values"], r.cardinality) for r in metadata.flatten_aspects(spark.createDataFrame([(json.dumps(doc),)], "payload string")).collect()}
    assert aspects == {"Game": (True, False, ["P"], "SINGLE"), "Note": (False, False, [], "SINGLE")}


def test_generated_text_is_held_against_its_source(spark):
    out = {"title": "Card 201/165 from 1999", "items": [{"note": "price 5"}, {"note": "qty 77"}], "descriptionEn": "2031 and 4242", "warnings": ["77 1998"], "grade": 10}
    df = spark.createDataFrame([("t", "no. 201 of 165, year 1996", json.dumps(out))], "target_id string, source_text string, output string")
    flags = {(r.field, r.kind, r.number) for r in audit.audit_generated_text(df).collect()}
    assert flags == {("title", "year", "1999"), ("items[1].note", "number", "77")}


def issues(spark, check, *outputs):
    df = spark.createDataFrame([(i, o if isinstance(o, str) or o is None else json.dumps(o)) for i, o in enumerate(outputs)], "id int, output string")
    return [sorted(r.issues) for r in check(df).orderBy("id").collect()]


def test_output_schemas(spark):
    copy = {"descriptionEn": "d" * 20, "itemSpecifics": {"Game": "Pokemon"}, "confidence": 0.9, "warnings": [{"field": "x", "message": "m"}]}
    without = lambda n: {k: v for k, v in copy.items() if k != n}
    assert issues(
        spark, audit.validate_copy, copy, without("warnings"), without("confidence"), copy | {"descriptionEn": "short"}, copy | {"descriptionEn": 5}, copy | {"itemSpecifics": {"a" * 66: "b"}},
        copy | {"itemSpecifics": {"a": 5}}, copy | {"itemSpecifics": {}}, copy | {"confidence": 1.5}, copy | {"confidence": "1"}, copy | {"warnings": [{"field": "x", "message": "m" * 501}]},
        copy | {"warnings": None}, "{oops", [copy], None,
    ) == [
        [], [], ["confidence"], ["descriptionEn"], ["descriptionEn"], ["itemSpecifics"], ["itemSpecifics"], [], ["confidence"], ["confidence"], ["warnings"], ["warnings"], ["(root)"], ["(root)"], ["(root)"],
    ]
    name = {"cardNameEn": "Mew", "setNameEn": None, "characterEn": "Mew", "confidence": 1}
    assert issues(spark, audit.validate_translation, name, name | {"cardNameEn": ""}, name | {"characterEn": "x" * 81}, {k: v for k, v in name.items() if k != "setNameEn"}) == [
        [], ["cardNameEn"], ["characterEn"], ["setNameEn"],
    ]


def test_nested_selectors_and_blocks(spark):
    html = '<div id="list"><ul class="a b"><li data-k="7"><p><em>no</em></p><em>yes 12 </em></li><li></li></ul></div><ul><li>x</li></ul>'
    html += '<script type="application/ld+json">[{"@type": "A"}, {"@type": "B"}]</script><script type="application/ld+json">{"@graph": [{"@type": "C"}], "sku": "s9"}</script>'
    df = spark.createDataFrame([(1, "https://s.jp/", html)], "page_id long, url string, html string")
    s = pages.Selector
    config = pages.CardConfig(s(css="#list ul.a.b > li"), {"direct": s(css="li > em", regex="([0-9]+)", required=True), "any": s(css="li em"), "key": s(css="li[data-k='7']", attribute="data-k")})
    got = [(r.direct, r.any, r.key, r.missing_required) for r in pages.extract_listing_cards(df, config).orderBy("position").collect()]
    assert got == [("12", "no", "7", []), (None, None, None, ["direct"])]
    blocks = pages.extract_json_ld(df).orderBy("position")
    assert [(r.types, r.type) for r in blocks.collect()] == [(["A", "B"], "A"), (["C"], "C")]
    ids = pages.source_ids(blocks.withColumns({"url": F.lit("https://s.jp/"), "k": F.lit("")}), [("attribute", "k"), ("json_ld", "sku")])
    assert [r.source_id for r in ids.collect()] == ["s9"]


def test_vanished_stream(spark, arriving, tmp_path):
    got = run(streams.stream_vanished(arriving(), F.col("user_id"), "ts", 86_400_000, "400 days"), tmp_path, spark)
    want = {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
    assert {int(r.key) for r in got.collect()} - {-1} == want


def run(df, folder, spark):
    """The whole stream, file by file, into a table."""
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Events in four files, each with the events of its quarter in reverse, and a late marker that moves the watermark on."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").toPandas()
    n = len(rows) // 4
    for i in range(4):
        rows.iloc[i * n : (i + 1) * n if i < 3 else None][::-1].to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
    end = rows.iloc[-1:].assign(event_id=10**9, user_id=-1)
    for i in (4, 5):
        end.assign(ts=end.ts + pd.Timedelta(days=1000 * (i - 3))).to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return lambda: streams.stream_listings(spark, str(folder), schema, files=1)


def test_change_stream_equals_its_batch_twin(spark, arriving, tmp_path):
    from kontor.plans.snapshots import event_changes

    got = run(streams.stream_changes(arriving(), F.col("user_id"), "ts", "event_id", "value", "400 days"), tmp_path, spark)
    want = {(r.user_id, r.event_id, r.previous, r.value) for r in event_changes(spark, SF).collect()}
    assert {(int(r.key), r.event_id, r.previous, r.value) for r in got.where("key <> '-1'").collect()} == want


def test_change_stream_holds_keys_in_shards(spark, arriving, tmp_path):
    from kontor.plans.snapshots import event_changes

    # some rows leave with each file, so last values are carried from batch to batch; a tenth of the keys has no name
    unnamed = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    out = streams.stream_changes(arriving(), unnamed, "ts", "event_id", "value", "2 days", shards=3)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert 0 < max(batches) <= 3
    got = spark.read.parquet(f"{tmp_path}/out")
    named = {(r.user_id, r.event_id, r.previous, r.value) for r in event_changes(spark, SF).collect() if r.user_id % 10}
    assert {(int(r.key), r.event_id, r.previous, r.value) for r in got.where("key <> '-1'").collect()} == named
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 10 = 0").orderBy("ts", "event_id").collect()
    moves = {(b.event_id, a.value, b.value) for a, b in zip(events, events[1:]) if a.value != b.value}
    assert {(r.event_id, r.previous, r.value) for r in got.where("key is null").collect()} == moves


def test_dedup_and_windows_on_a_stream(spark, arriving, tmp_path):
    once = run(streams.stream_dedup(arriving().where("user_id >= 0"), ["user_id", "event_type"], "ts", "400 days"), tmp_path / "a", spark)
    assert once.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().count()
    counts = run(streams.changes_per_window(arriving(), "ts", "1 day", delay="1 day"), tmp_path / "b", spark)
    batch = streams.changes_per_window(spark.read.parquet(f"{SF}/events.parquet"), "ts", "1 day")
    assert {(r.window_start, r.n) for r in counts.collect()} >= {(r.window_start, r.n) for r in batch.collect()}


def test_upsert_stream_keeps_snapshots(spark, tmp_path):
    schema = "supplier_id int, source_product_id string, price double, stock_status string, disappeared_at timestamp"
    source = tmp_path / "in"
    for i, rows in enumerate(([(1, "a", 1.0, "IN_STOCK"), (1, "b", 2.0, "IN_STOCK")], [(1, "a", 3.0, "IN_STOCK")])):
        spark.createDataFrame(rows, "supplier_id int, source_product_id string, price double, stock_status string").coalesce(1).write.mode("append").parquet(str(source))
        df = streams.stream_listings(spark, str(source), "supplier_id int, source_product_id string, price double, stock_status string")
        query = streams.stream_upsert(df, str(tmp_path / "snap"), F.to_timestamp(F.lit("2024-01-01")), schema, str(tmp_path / "cp"))
        query.awaitTermination(60)
        assert query.exception() is None
    last = {r.source_product_id: (r.price, r.stock_status) for r in spark.read.parquet(str(tmp_path / "snap")).collect()}
    assert last == {"a": (3.0, "IN_STOCK"), "b": (2.0, "OUT_OF_STOCK")}


def test_a_price_behind_a_long_text(spark):
    card = f'<li class="far"><a href="/p/1">{"word " * 1000}</a><b>¥ 1,200</b></li>'
    df = spark.createDataFrame([(1, f"<ul>{card * 4}</ul>")], "page_id long, html string")
    got = [(r["class"], r.n, r.price_share) for r in pages.discover_card_classes(df).collect()]
    assert got == [("far", 4, 1.0)]


def test_deeply_nested_output_is_audited(spark):
    out = {"a": {"b": {"c": {"d": {"e": {"Year": "1999"}}}}}, "wrap": {"items": [{"specifics": {"Year": 2031}}]}, "x": [[[[[["qty 77"]]]]]]}
    df = spark.createDataFrame([("t", "no numbers", json.dumps(out))], "target_id string, source_text string, output string")
    got = {(r.field, r.kind, r.number) for r in audit.audit_generated_text(df).collect()}
    assert got == {("a.b.c.d.e.Year", "year", "1999"), ("wrap.items[0].specifics.Year", "year", "2031"), ("x[0][0][0][0][0][0]", "number", "77")}
