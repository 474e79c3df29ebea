from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kontor.functions import rules, text, urls
from kontor.operators.attributes import aggregate_confidence, parse_titles, prefer_trust, reliability, to_long, to_wide


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [("【PSA１０】　リザードンｅｘ", "[PSA10] リザードンex"), ("a—b  c d", "a-b c d"), ("（ａ）／", "(a)/"), ("ピカチュー", "ピカチュー"), ("ｱｲｳ", "ｱｲｳ")],
)
def test_normal_form(spark, given, want):
    assert one(spark, given, text.normalised) == want


def test_comparison_key(spark):
    keys = {one(spark, t, text.comparison_key) for t in ("リザードン ex", "リザードンｅｘ", "リザードンex", "リザードン・ＥＸ")}
    assert keys == {"リザードンex"}
    assert one(spark, "リザドン", text.comparison_key) != one(spark, "リザードン", text.comparison_key)


@pytest.mark.parametrize("given, want", [("¥128,000(税込)", 128000), ("￥４５，８００", 45800), ("8500円", 8500), ("SOLD OUT", None), ("", None), (None, None)])
def test_price(spark, given, want):
    got = one(spark, given, text.price)
    assert got == (None if want is None else Decimal(want))


def test_title_attributes(spark):
    df = spark.createDataFrame(
        [(1, "【PSA10】リザードンex SAR 201/165 黒煙の支配者"), (2, "リザードンex 010/165"), (3, "美品PSA10"), (4, "BGS9.5 Charizard english"), (5, "x")],
        "id int, title string",
    )
    got = {r.id: r for r in parse_titles(df).collect()}
    a = got[1]
    assert (a.card_number.value, a.rarity.value, a.grading_company.value, a.grade.value, a.language.value) == ("201/165", "SAR", "PSA", "10.0", "JAPANESE")
    assert a.card_name.value == "リザードンex 黒煙の支配者" and a.warnings == [] and a.overall_confidence == Decimal("0.9")
    assert got[2].grade.value is None and got[2].grade.source == "unknown" and got[2].overall_confidence == 0
    assert got[3].grade.value == "10.0"  # a Japanese letter before it is a boundary
    assert got[4].grade.value == "9.5" and got[4].warnings == ["MISSING_CARD_NUMBER", "NOT_GRADE_10"] and got[4].language.value == "ENGLISH"
    assert "MISSING_CARD_NAME" in got[5].warnings


def test_rules_override_and_structured_wins(spark):
    df = spark.createDataFrame([("abc set:SV9 x",)], "title string")
    fields, warnings = rules.title_rules(F.col("title"), text.attributes(F.col("title")), [("set_code", r"set:(\w+)", 0.99), ("rarity", "(", 1.0)])
    assert warnings == ["INVALID_SUPPLIER_RULE:rarity"]
    assert df.select(fields["set_code"].alias("s")).first().s.value == "SV9"
    fields = rules.structured(fields, {"set_code": F.lit("SV2a"), "grading_company": F.lit("ace"), "grade": F.lit("")}, text.COMPANIES)
    r = df.select(fields["set_code"].alias("s"), fields["grading_company"].alias("c"), fields["grade"].alias("g")).first()
    assert (r.s.value, r.s.source, r.c.value, r.g.value) == ("SV2a", "structured_data", "OTHER", None)


def test_stock_rules(spark):
    table = [("残り\\s*([0-9]+)\\s*点", "IN_STOCK", 1), ("(?i)sold\\s*out", "OUT_OF_STOCK", None), ("在庫あり|カート", "IN_STOCK", None)]
    df = spark.createDataFrame([("残り 2 点",), ("SOLD OUT",), ("カートに入れる",), ("?",), (None,)], "t string")
    get = lambda exact: [tuple(r.s) for r in df.select(rules.first_match(F.col("t"), table, exact).alias("s")).collect()]
    assert get(True) == [("IN_STOCK", 2), ("OUT_OF_STOCK", None), ("IN_STOCK", None), ("UNKNOWN", None), ("UNKNOWN", None)]
    assert [q for _, q in get(False)] == [None] * 5


CLAIMS = [
    ("【PSA10】リザードンex SAR", None, None, "psa-category", None, None, "CONFIRMED"),
    ("【PSA10】リザードンex", None, None, None, None, None, "REVIEW"),
    ("PSA10 謎のカード", None, None, None, None, None, "REVIEW"),
    ("リザードンex", None, None, None, None, None, "REJECTED"),
    ("【PSA9】リザードンex", None, None, None, None, None, "REJECTED"),
    ("BGS9.5 リザードン", None, None, None, None, None, "REJECTED"),
    ("PSA10相当 リザードン", None, None, None, None, None, "REJECTED"),
    ("PSA10 ポケモンカード まとめ売り", None, None, None, None, None, "REJECTED"),
    ("PSA10 遊戯王", None, None, None, None, None, "REJECTED"),
    ("リザードン", None, "GEM MT", "psa", "PSA", 10, "CONFIRMED"),
    ("PSA10 リザードン", None, None, None, "BGS", 10, "REJECTED"),
    ("PSA10 リザードン", None, None, None, "", 9, "REVIEW"),
    ("カードGXリザードン PSA10", None, "PSA 10", None, None, None, "CONFIRMED"),
]


def test_grade_claims(spark):
    rows = [(i, t, b, d, c, sc, None if g is None else Decimal(g)) for i, (t, b, d, c, sc, g, _) in enumerate(CLAIMS)]
    schema = "id int, title string, breadcrumbs array<string>, description string, source_category_url string, structured_company string, structured_grade decimal(3,1)"
    got = {r.id: r.verdict for r in rules.grade_claims(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: c[-1] for i, c in enumerate(CLAIMS)}


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTP://M.Shop.JP:80/a//b/?utm_source=x&b=2&a=1&page=3#top", "https://m.shop.jp/a/b?a=1&b=2"),
        ("https://shop.jp/a/../b/./c/..?a=2&a=1&B=3&b=4", "https://shop.jp/b?a=2&a=1&b=4&B=3"), ("https://shop.jp/../x/%2F/.", "https://shop.jp/x/%2F"),
        ("https://shop.jp", "https://shop.jp/"), ("https://shop.jp/?ref=1", "https://shop.jp/"), ("nonsense", None), (None, None),
    ],
)
def test_canonical_urls(spark, given, want):
    assert one(spark, given, urls.canonical) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("https://shop.jp/x", None), ("https://a.shop.jp/x", None), ("http://shop.jp/", "scheme"), ("https://u:p@shop.jp/", "credentials"),
        ("https://127.0.0.1/", "private host"), ("https://172.20.1.1/", "private host"), ("https://8.8.8.8/", "host not allowed"),
        ("https://evilshop.jp/", "host not allowed"), ("x", "not an absolute url"), (None, "not an absolute url"), ("https://[::1]/", "private host"),
    ],
)
def test_refusals(spark, given, want):
    assert one(spark, given, lambda c: urls.refusal(c, ("shop.jp",))) == want


def test_search_query_and_similarity(spark):
    df = spark.createDataFrame([("Charizard ex", "006/165", "PSA", Decimal("10.0")), (None, "1", "PSA", Decimal("9.5")), ("Mew", None, "BGS", Decimal("9.5"))], "n string, c string, g string, v decimal(3,1)")
    got = [r.q for r in df.select(text.search_query(*map(F.col, "ncgv")).alias("q")).collect()]
    assert got == ["Charizard ex 006/165 PSA 10", None, "Mew BGS 9.5"]
    pairs = spark.createDataFrame([("リザードン ex", "リザードンex"), ("abcd", "abcx"), ("", "a"), ("", "")], "a string, b string")
    assert [r.s for r in pairs.select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.75, 0.0, 1.0]


def test_attribute_forms(spark):
    rows = [("l", "name", "A", "title_parser", Decimal("0.9"), 1), ("l", "name", "B", "manual", Decimal("0.1"), 2), ("l", "name", "C", "manual", Decimal("0.1"), 3), ("l", "no", None, "unknown", Decimal("0"), 4)]
    df = spark.createDataFrame(rows, "listing_id string, field string, value string, source string, confidence decimal(5,4), seq int")
    best = prefer_trust(df, ["listing_id", "field"], "seq")
    assert {r.field: r.value for r in best.collect()} == {"name": "B", "no": None}
    assert aggregate_confidence(best, ["listing_id"]).first().confidence == 0
    assert [r.is_reliable for r in reliability(df).orderBy("seq").collect()] == [True, False, False, False]
    parsed = parse_titles(spark.createDataFrame([("l", "PSA10 ピカチュウ 1/2")], "listing_id string, title string"))
    long = to_long(parsed, ["listing_id"], ["grade", "card_name"])
    assert {(r.field, r.value) for r in long.collect()} == {("grade", "10.0"), ("card_name", "ピカチュウ")}
    assert to_wide(long, ["listing_id"], ["grade", "card_name"]).first().grade == "10.0"
