from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from kontor.operators import listings as ops
from kontor.operators import names

SNAP = "supplier_id int, source_product_id string, content_hash string, price decimal(20,6), stock_status string, stock_qty int, disappeared_at timestamp"


def snap(spark, rows):
    return spark.createDataFrame([(s, p, h, Decimal(v), st, q, None) for s, p, h, v, st, q in rows], SNAP)


def two(spark):
    current = snap(spark, [(1, "a", "h1", "10", "IN_STOCK", 1), (1, "b", "h2", "20", "IN_STOCK", None), (1, "c", "h3", "30", "IN_STOCK", 2), (2, "z", "h9", "5", "IN_STOCK", 1)])
    incoming = snap(spark, [(1, "a", "h1", "10.00", "IN_STOCK", 1), (1, "b", "h2x", "21", "IN_STOCK", None), (1, "d", "h4", "40", "IN_STOCK", 1)]).drop("disappeared_at")
    return current, incoming


def test_diff_vanished_and_stats(spark):
    current, incoming = two(spark)
    diff = ops.diff_listings(current, incoming)
    got = {(r.supplier_id, r.source_product_id): (r.status, r.price_changed, r.stock_changed) for r in diff.collect()}
    assert got == {(1, "a"): ("unchanged", False, False), (1, "b"): ("updated", True, False), (1, "c"): ("unseen", False, False), (1, "d"): ("created", False, False), (2, "z"): ("unseen", False, False)}
    gone = {(r.supplier_id, r.source_product_id) for r in ops.vanished(current, incoming).collect()}
    assert gone == {(1, "c")}  # a supplier that delivered nothing loses nothing
    s = {r.supplier_id: r for r in ops.sync_stats(diff).collect()}
    assert (s[1].seen, s[1].created, s[1].updated, s[1].unchanged, s[1].price_changes) == (3, 1, 1, 1, 2)  # a new listing brings a price
    prices, stocks = ops.history_rows(diff, F.to_timestamp(F.lit("2024-01-01")))
    assert {r.source_product_id for r in prices.collect()} == {"b", "d"} and {r.source_product_id for r in stocks.collect()} == {"d"}


def test_rejected_and_repeated_rows(spark):
    current, incoming = two(spark)
    at = lambda h: F.to_timestamp(F.lit(f"2024-01-01 0{h}:00:00"))
    rows = incoming.withColumns({"verdict": F.when(F.col("source_product_id").isin("a", "d"), "REJECTED").otherwise("CONFIRMED"), "fetched_at": at(6)})
    rows = rows.unionByName(rows.where("source_product_id = 'b'").withColumns({"price": F.lit(99).cast("decimal(20,6)"), "fetched_at": at(5)}))
    diff = ops.diff_listings(current, rows)
    got = {r.source_product_id: (r.status, r.price) for r in diff.collect()}
    assert got["a"][0] == got["d"][0] == "skipped" and got["b"] == ("updated", 21) and len(got) == 5
    s = {r.supplier_id: r for r in ops.sync_stats(diff).collect()}[1]
    assert (s.seen, s.skipped, s.confirmed, s.review, s.rejected, s.created, s.price_changes) == (3, 2, 1, 0, 2, 0, 1)
    after = {r.source_product_id: r for r in ops.upsert_listings(current, rows, at(7)).collect()}
    assert set(after) == {"a", "b", "c", "z"} and after["a"].disappeared_at is None and after["b"].price == 21 and after["c"].stock_status == "OUT_OF_STOCK"


def test_upsert_is_idempotent(spark):
    current, incoming = two(spark)
    at = F.to_timestamp(F.lit("2024-01-01"))
    once = ops.upsert_listings(current, incoming, at)
    rows = {(r.supplier_id, r.source_product_id): r for r in once.collect()}
    assert len(rows) == 5 and rows[1, "c"].disappeared_at == datetime(2024, 1, 1) and rows[1, "c"].stock_status == "OUT_OF_STOCK"
    assert rows[2, "z"].disappeared_at is None and rows[1, "b"].price == 21
    twice = ops.upsert_listings(once, incoming, F.to_timestamp(F.lit("2025-01-01")))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_quarantine(spark):
    rows = [(1, Decimal("-1"), 1, 0.5), (2, Decimal("1"), -1, 2.0), (3, None, None, None), (4, Decimal("1"), 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, price decimal(20,6), stock_qty int, confidence double").withColumn("k", F.col("id") % 2)
    good, bad = ops.quality_gate(df, ops.listing_rules(), {"one_per_k": (["k"], F.col("id") > 2)})
    assert {r.id for r in good.collect()} == {3, 4}
    assert {r.id: r.reasons for r in bad.collect()} == {1: ["price_not_negative"], 2: ["stock_not_negative", "confidence_in_range"]}
    _, bad = ops.quality_gate(df, [], {"one_per_k": (["k"], F.col("id") > 0)})
    assert bad.count() == 4
    attrs = spark.createDataFrame([("x", "unknown", 0.0), (None, "manual", 0.5), (None, "unknown", 0.0)], "value string, source string, confidence double")
    _, bad = ops.quality_gate(attrs, ops.attribute_rules())
    assert sorted(r.reasons[0] for r in bad.collect()) == ["no_value_no_confidence", "unknown_has_no_value"]
    schema = "quantity int, status string, price double, currency string, title string, redacted boolean, approved boolean, approved_at timestamp, score double, active_min double, active_max double, name_en string, name_key string, verified boolean, verified_by string"
    bad_row = (-1, "PUBLISHED", None, "USD", "x" * 81, True, True, None, 1.5, 2.0, 1.0, " ", "k", True, None)
    _, bad = ops.quality_gate(spark.createDataFrame([bad_row], schema), ops.market_rules())
    assert len(bad.first().reasons) == 8


DICT = "name_ja string, name_en string, set_code string, card_number string, source string, verified boolean"


def test_names_resolve_in_tiers(spark):
    d = spark.createDataFrame(
        [
            ("リザードンex", "Charizard ex", "sv3a", "006/165", "a", True), ("リザードンex", "Charizard ex", "sv9", "1/1", "b", False),
            ("ミュウ", "Mew", "s1", "5/5", "a", True), ("ミュウ", "Mew V", "s2", "5/5", "a", True), ("カイ", "Irida", None, None, "a", False),
        ],
        DICT,
    )
    q = spark.createDataFrame(
        [(1, "リザードン ex", "SV3a", "006/165"), (2, "リザードンｅｘ", None, "006/165"), (3, "リザードンex", "sv3a", None), (4, "ミュウ", "s1", "5/5"), (5, "ミュウ", None, "5/5"), (6, "ミュウ", None, "9/9"), (7, "カイ", None, None), (8, "無", None, None)],
        "listing_id int, name_ja string, set_code string, card_number string",
    )
    got = {r.listing_id: (r.precision, r.name_en, round(r.confidence, 2), r.n_candidates) for r in names.resolve_names(q, d).collect()}
    assert got == {
        1: ("EXACT", "Charizard ex", 1.0, 0), 2: ("NAME_AND_NUMBER", "Charizard ex", 0.95, 0), 3: ("NAME_ONLY", "Charizard ex", 0.7, 0), 4: ("EXACT", "Mew", 1.0, 0),
        5: ("AMBIGUOUS", None, 0.0, 2), 6: ("AMBIGUOUS", None, 0.0, 2), 7: ("NAME_ONLY", "Irida", 0.6, 0), 8: ("NOT_FOUND", None, 0.0, 0),
    }


def test_import_keeps_partial_keys_apart(spark):
    lines = spark.createDataFrame([(1, "ミュウ\tMew"), (2, "ミュウ,Mew again"), (3, "x"), (4, "a\tb\ts1\t1"), (5, "a\tc\ts1\t1"), (6, "a\tb\ts1"), (7, "a\tb\ts1"), (8, "")], "line_no long, line string")
    known = spark.createDataFrame([("zz", None, None)], "name_key string, set_code string, card_number string")
    added, rejected, counts = names.import_names(lines, known)
    assert {r.line_no for r in added.collect()} == {1, 4, 6, 7} and [r.line_no for r in rejected.collect()] == [3]
    assert tuple(counts.first()) == (6, 4, 1, 2)
