from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kontor.operators import images, market, matching, profit, publishing, sourcing

OFFER = "product_id int, supplier_id int, price decimal(20,6), domestic_shipping decimal(20,6), handling decimal(20,6), lead_time_days int, reliability decimal(5,4), trust decimal(5,2), stock_status string, stock_qty int, safety_stock int"


def offer(**change):
    base = dict(product_id=1, supplier_id=1, price="12800", domestic_shipping="500", handling="200", lead_time_days=3, reliability="1", trust="50", stock_status="IN_STOCK", stock_qty=1, safety_stock=0)
    row = base | change
    return tuple(Decimal(v) if isinstance(v, str) and k not in ("stock_status",) else v for k, v in row.items())


def test_landed_cost_and_ranking(spark):
    rows = [
        offer(), offer(supplier_id=2, price="12000", stock_status="OUT_OF_STOCK"), offer(supplier_id=3, stock_qty=None, reliability="0.5"),
        offer(supplier_id=4, price="0"), offer(supplier_id=5, stock_qty=2, safety_stock=2, price="1"), offer(supplier_id=6, trust="60", handling="200"),
    ]
    df = sourcing.landed_cost(spark.createDataFrame(rows, OFFER))
    got = {r.supplier_id: r for r in df.collect()}
    assert got[1].landed_cost == 13500 and got[1].effective_cost == 13650
    assert got[3].available == 1 and got[3].effective_cost == 13650 + 6750
    assert not got[4].purchasable and got[4].reasons == ["price is zero"] and got[5].reasons == ["held as safety stock"]
    ranks = {r.supplier_id: r["rank"] for r in sourcing.rank_sources(df).collect()}
    assert ranks[6] == 1 and ranks[1] == 2 and ranks[3] == 3
    best = sourcing.recommend_source(df, cap=3).first()
    assert (best.supplier_id, best.quantity) == (6, 1)


GOLDEN = [
    ("150", "OPTIMISTIC", "151.026666", "13.973334", "2096.0001", "8.4687"), ("150", "BASE", "152.676666", "12.323334", "1848.5001", "7.4687"),
    ("150", "PESSIMISTIC", "165.643333", "-0.643333", "-91.6749525", "-0.3899"), ("190", "OPTIMISTIC", "159.986666", "45.013334", "6752.0001", "21.9577"),
    ("190", "BASE", "162.036666", "42.963334", "6444.5001", "20.9577"), ("190", "PESSIMISTIC", "175.803333", "29.196667", "4160.5250475", "14.2423"),
]


def sale(spark, *prices):
    rows = [(i, Decimal("12800"), Decimal("500"), Decimal("0"), Decimal(p), Decimal("150")) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "offer_id int, purchase_price decimal(20,6), domestic_shipping_jpy decimal(20,6), handling_jpy decimal(20,6), selling_price decimal(20,6), fx_rate decimal(20,10)")


def test_profit_to_the_last_digit(spark):
    got = {(str(r.selling_price.normalize()), r.scenario): r for r in profit.profit_scenarios(sale(spark, "150", "190")).collect()}
    for price, scenario, cost, gain, jpy, margin in GOLDEN:
        r = got[str(Decimal(price).normalize()), scenario]
        assert (r.total_cost, r.profit, r.profit_jpy, r.margin_percent) == tuple(map(Decimal, (cost, gain, jpy, margin)))
    assert got[str(Decimal(150).normalize()), "PESSIMISTIC"].warnings == ["PESSIMISTIC scenario is loss-making"]


@pytest.mark.parametrize("mode, price, duty, tax, warned", [("SELLER_PAID", "150", 7.5, 31.5, 0), ("SELLER_PAID", "149.99", 0, 0, 0), ("BUYER_PAID", "500", 0, 0, 0), ("MANUAL_REVIEW", "500", 0, 0, 1), ("CARRIER_QUOTE_REQUIRED", "500", 0, 0, 1)])
def test_customs(spark, mode, price, duty, tax, warned):
    terms = profit.Terms(mode=mode, de_minimis="150", duty="5", import_tax="20")
    r = profit.profit_scenarios(sale(spark, price), terms, ("BASE",)).first()
    assert (float(r.cost_duty), float(r.cost_import_tax)) == (duty, tax)
    assert sum("manual" in w or "quote" in w for w in r.warnings) == warned


def test_price_floor(spark):
    r = profit.price_floor(sale(spark, "1")).first()
    assert r.minimum_price == Decimal("192.61") and r.verified and r.binding == "MARGIN_FLOOR"
    below = profit.profit_scenarios(sale(spark, "192.60"), only=("PESSIMISTIC",)).first()
    assert below.margin_percent < 15
    none = profit.price_floor(sale(spark, "1"), min_margin="90").first()
    assert none.minimum_price is None
    # the exemption below the de minimis value makes a cheaper price feasible than the taxed segment does
    step = profit.price_floor(sale(spark, "1"), profit.Terms(mode="SELLER_PAID", de_minimis="250", duty="30", import_tax="20")).first()
    assert step.minimum_price == Decimal("192.61")


ASK = "query_id string, position int, item_id string, price decimal(20,6), currency string"


def test_asks(spark):
    rows = [("a", 1, "i", "300", "USD"), ("a", 2, "j", "100", "USD"), ("a", 3, "k", "200", "USD"), ("a", 4, "l", "1", "EUR"), ("b", 1, "i", "4", "USD"), ("b", 2, "j", "2", "USD"), ("c", 1, None, None, None)]
    df = spark.createDataFrame([(q, n, i, None if p is None else Decimal(p), c) for q, n, i, p, c in rows], ASK)
    got = {r.query_id: r for r in market.summarise_asks(df).collect()}
    assert (got["a"].active_min, got["a"].active_median, got["a"].active_max, got["a"].active_count, got["a"].n_other_currency) == (100, 200, 300, 3, 1)
    assert got["b"].active_median == 2 and got["b"].caveats == ["fewer than three"] and got["c"].active_count == 0


IDENTITY = "id int, card_name_ja string, card_name_en string, card_number string, set_code string, set_name string, rarity string, release_year int, language string, grading_company string, grade decimal(3,1)"


def test_match_decisions(spark):
    one = (1, "リザードンex", None, "201/165", "SV2a", None, "SAR", 2023, "JAPANESE", "PSA", Decimal(10))
    variants = {
        10: dict(card_name_ja="リザードン ex"), 11: dict(set_code="SV9"), 12: dict(release_year=2020), 13: dict(set_code=None), 14: dict(card_name_ja="ピカチュウ", rarity="R", set_code=None),
    }
    columns = [c.split()[0] for c in IDENTITY.split(", ")]
    rows = [tuple((dict(zip(columns, one)) | v | {"id": i}).values()) for i, v in variants.items()]
    a = spark.createDataFrame([one], IDENTITY).withColumnRenamed("id", "listing_id")
    b = spark.createDataFrame(rows, IDENTITY).withColumnRenamed("id", "product_id")
    pairs, alone = matching.candidate_pairs(a, b)
    scored = matching.score_pairs(pairs)
    got = {r.b_product_id: (r.decision, r.blockers) for r in scored.collect()}
    assert got == {10: ("AUTO_MERGE", []), 11: ("REJECT", ["set_code"]), 12: ("REVIEW", ["release_year"]), 13: ("REVIEW", []), 14: ("REJECT", [])}
    links, review = matching.link_listings(scored, scored.where("b_product_id = 12").select("a_listing_id", "b_product_id"))
    assert [tuple(r)[:2] for r in links.collect()] == [(1, 10)] and review.count() == 0
    none = a.withColumn("card_number", F.lit(None).cast("string"))
    assert matching.candidate_pairs(none, b)[0].count() == 0 and matching.candidate_pairs(none, b)[1].count() == 1


def test_titles_and_skus(spark):
    schema = "release_year int, language string, card_name_en string, set_name string, card_number string, rarity string, grading_company string, grade decimal(3,1)"
    rows = [(2023, "JAPANESE", "Charizard ex", "Ruler of the Black Flame", "201/165", "SAR", "PSA", Decimal(10)), (2023, "JAPANESE", "Very " * 20 + "Long", "S", "1", "SR", "PSA", Decimal(10)), (None, "ENGLISH", "Perfect 美 Mew", None, None, None, "BGS", Decimal("9.5")), (None, "ENGLISH", "", None, None, None, "PSA", Decimal(10))]
    got = publishing.listing_titles(spark.createDataFrame(rows, schema)).collect()
    assert got[0].title == "2023 Pokemon Japanese Charizard ex 201/165 SAR PSA 10 GEM MINT" and got[0].omitted == ["set_name"]
    assert got[1].title_length <= 80 and got[1].omitted == ["set_name", "rarity", "gem_mint", "year", "number"] and "card name truncated" in got[1].title_warnings
    assert got[1].title.startswith("Pokemon Japanese Very") and got[1].title.endswith("PSA 10")
    assert got[2].title == "Pokemon Perfect Mew BGS 9.5" and got[2].title_warnings == ["promotional term perfect"]
    assert got[3].title == "" and got[3].title_warnings == ["card name is empty"]
    c = F.lit
    make = lambda name, number: publishing.sku(c(name), c(number), c("SV2a"), c("JAPANESE"), c("PSA"), c(Decimal("10.0")))
    r = spark.range(1).select(make("リザードンex", "201/165").alias("x"), make("リザードン ex", "201/165").alias("y"), make("ピカチュウ", "1").alias("z")).first()
    assert r.x == r.y != r.z and r.x.startswith("CB-SV2A-201165-JP-PSA10-") and len(r.x) <= 40


KNOWN = dict(
    verdict="CONFIRMED", parse_confidence=0.9, card_name_en="Mew", card_number="1/1", language="JAPANESE", has_images=True, image_approved=True, image_confidence=0.95,
    representative_image=False, available=1, quantity=1, title="Mew", missing_aspects=[], descriptors_resolved=True, ai_confidence=0.9, ai_warnings=[], base_profit_jpy=Decimal(2000),
    base_margin=Decimal(20), pessimistic_profit=Decimal(1), profit_warnings=[], selling_price=Decimal(100), market_sufficient=True, duplicate_listing=False,
)
GATE = (
    "verdict string, parse_confidence double, card_name_en string, card_number string, language string, has_images boolean, image_approved boolean, image_confidence double, representative_image boolean, "
    "available int, quantity int, title string, missing_aspects array<string>, descriptors_resolved boolean, ai_confidence double, ai_warnings array<string>, base_profit_jpy decimal(20,6), "
    "base_margin decimal(12,4), pessimistic_profit decimal(20,6), profit_warnings array<string>, selling_price decimal(20,6), market_sufficient boolean, duplicate_listing boolean"
)


def test_what_is_not_known_blocks(spark):
    names = list(KNOWN)
    rows = [tuple(KNOWN.values())] + [tuple((KNOWN | {n: None}).values()) for n in names]
    got = publishing.eligibility(spark.createDataFrame(rows, GATE).coalesce(1)).select("eligible", "manual_review", "blockers.code").collect()
    assert got[0].eligible and got[0].code == []
    free = {n for n, r in zip(names, got[1:], strict=True) if r.eligible}
    assert free == {"image_confidence", "ai_confidence"}  # an unknown list is not an empty one
    assert {n for n, r in zip(names, got[1:], strict=True) if r.manual_review} == {"card_number", "representative_image", "market_sufficient", "ai_warnings"}


def test_aspects_belong_to_categories(spark):
    items = spark.createDataFrame([(1, "a", {" game ": "P", "Year": "1999", "GAME": "Q"}), (2, "b", {"game": "P"}), (3, "c", {"x": "y"})], "listing_id int, category_id string, specifics map<string,string>")
    allowed = spark.createDataFrame([("a", "Game", True), ("a", "game", False), ("b", "Year", True)], "category_id string, name string, required boolean")
    good, bad = publishing.split_aspects(items, allowed)
    assert [tuple(r) for r in good.collect()] == [(1, "game", "Q")]
    assert sorted(tuple(r) for r in bad.collect()) == [(1, "Year"), (2, "game"), (3, "x")]
    assert {r.listing_id: r.missing for r in publishing.missing_aspects(items, allowed).collect()} == {1: [], 2: ["year"], 3: []}


REGION = "image_id string, kind string, source string, x double, y double, width double, height double, confidence double, position int"


def test_regions(spark):
    rows = [("i", "CERT", "OCR", 0.0, 0.0, 10.0, 10.0, 0.8, 1), ("i", "CERT", "TEMPLATE", 2.0, 0.0, 10.0, 10.0, 0.6, 2), ("i", "CERT", "OCR", 1.0, 0.0, 10.0, 10.0, 0.7, 3), ("i", "BAR", "MANUAL", 5.0, 5.0, 1.0, 1.0, 0.1, 4), ("i", "BAR", "OCR", 5.0, 5.0, 1.0, 1.0, 0.9, 5)]
    got = {r.kind: r for r in images.consensus_regions(spark.createDataFrame(rows, REGION)).collect()}
    assert (got["CERT"].width, round(got["CERT"].confidence, 2), got["CERT"].n_agreeing) == (12.0, 0.95, 1)
    assert (got["BAR"].source, got["BAR"].confidence) == ("MANUAL", 1.0)
    img = spark.createDataFrame([("i", 100.0, 190.0, 0.0, 0.0, 100.0, 190.0), ("j", 100.0, 100.0, 0.0, 0.0, 100.0, 100.0)], "image_id string, image_width double, image_height double, slab_x double, slab_y double, slab_width double, slab_height double")
    region = spark.createDataFrame([("i", "CERT", "OCR", 5.0, 5.0, 20.0, 20.0, 0.9, 1), ("i", "BAR", "OCR", -1.0, 30.0, 20.0, 20.0, 0.9, 2)], REGION)
    safe = {r.image_id: r.failures for r in images.mask_safety(region, img).collect()}
    assert safe == {"i": ["BAR: overlaps the card", "BAR: starts outside"], "j": ["no regions", "not slab-shaped"]}


def test_costs_of_scenarios_are_compiled_and_those_of_one_rate_shared(spark):
    from kontor.operators import profit

    df = spark.range(3).selectExpr(
        "id", "cast(1000 * id as decimal(20,6)) AS purchase_price", "cast(300 as decimal(20,6)) AS domestic_shipping_jpy", "cast(0 as decimal(20,6)) AS handling_jpy",
        "cast(20 as decimal(20,6)) AS selling_price", "cast(150 as decimal(20,10)) AS fx_rate",
    )
    out = profit.profit_scenarios(df).select("id", "scenario", "warnings")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Join" not in plan  # a lambda would be interpreted with all below it
    got = {(r.id, r.scenario): r.warnings for r in out.collect()}
    assert len(got) == 9 and got[0, "BASE"][0] == "purchase price is zero" and got[2, "BASE"] == ["BASE scenario is loss-making"]
    assert profit.profit_scenarios(df, only=("BASE",)).count() == 3 and profit.profit_scenarios(df, only=("NONE",)).count() == 0
