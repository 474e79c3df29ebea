"""Cases that tables seldom hold: several approvals, empty and unknown facts, odd URLs, odd output, files of several splits."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from kontor.functions import money, rules, urls
from kontor.operators import audit, matching, profit, publishing
from kontor.sources import pages
from kontor.sources import listings as src


def test_any_approval_of_the_payload_counts(spark):
    listings = spark.createDataFrame([(i, i, "new") for i in range(1, 7)], "listing_id int, product_id int, payload_hash string")
    rows = [(1, "P", "old"), (1, "P", "new"), (2, "P", "new"), (2, "P", "old"), (3, "P", "old"), (4, "S", "new"), (5, "S", "new"), (5, "P", "new"), (1, "P", "new")]
    for given in (rows, rows[::-1]):
        approvals = spark.createDataFrame(given, "product_id int, environment string, payload_hash string").coalesce(1)
        out = publishing.approved_batch(listings, approvals, "P", dry_run=False, cap=2)
        assert out.columns == [*listings.columns, "block_reason"]
        assert {r.listing_id: r.block_reason for r in out.collect()} == {
            1: None, 2: None, 3: "payload changed since the approval", 4: "approved for another environment", 5: "run cap reached", 6: "no approval",
        }


def scored(spark, a, b):
    schema = "id string, card_name_ja string, card_name_en string, card_number string, set_code string, set_name string, rarity string, release_year int, language string, grading_company string, grade decimal(3,1)"
    base = ("x", "リザードンex", None, "201/165", "SV2a", None, "SAR", 2023, "JAPANESE", "PSA", Decimal("10.0"))
    names = [c.split()[0] for c in schema.split(", ")]
    row = lambda change: tuple(change.get(n, v) for n, v in zip(names, base, strict=True))
    x, y = (spark.createDataFrame([row(c)], schema) for c in (a, b))
    pairs = matching.candidate_pairs(x.withColumnRenamed("id", "listing_id"), y.withColumnRenamed("id", "product_id"))[0]
    r = matching.score_pairs(pairs).first()
    return r.blockers, r.decision


def test_an_empty_text_is_not_known(spark):
    assert scored(spark, {}, {}) == ([], "AUTO_MERGE")
    assert scored(spark, {"set_code": ""}, {})[0] == [] and scored(spark, {"set_code": ""}, {})[1] != "REJECT"
    assert scored(spark, {"set_code": "SV1"}, {}) == (["set_code"], "REJECT")
    assert scored(spark, {"rarity": ""}, {}) == scored(spark, {"rarity": None}, {})


def test_one_spelling_for_each_url(spark):
    def canonical(*given, **options):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string")
        return [r[0] for r in df.orderBy("i").select(urls.canonical(F.col("u"), **options)).collect()]

    assert len(set(canonical("https://s.jp/カ?q=a%20b", "https://s.jp/%E3%82%AB?q=a+b", "http://S.JP:80/x/../カ/?%71=a%20b#z"))) == 1
    assert canonical("https://s.jp/a b/\"😀\"?x=1=2&y&x=%", "https://s.jp/%zz?k=%E3%82", "https://s.jp/?utm%5Fsource=1&a=~*-._") == [
        "https://s.jp/a%20b/%22%F0%9F%98%80%22?x=1%3D2&x=%25&y=", "https://s.jp/%zz?k=%EF%BF%BD", "https://s.jp/?a=%7E*-._",
    ]
    assert canonical("https://s.jp/a/?sort=1&Page=2", keep=("page",), keep_slash=True) == ["https://s.jp/a/?Page=2"]
    assert canonical("https://s.jp/a//", "no url", None) == ["https://s.jp/a", None, None]


def test_own_generative_fields_add_to_the_others(spark):
    out = {"descriptionEn": "4242", "note": "77", "story": "99 1999", "deep": {"story": ["88"]}, "big": 1234567890123, "yes": True, "f": 2.50}
    df = spark.createDataFrame([("t", "nothing", json.dumps(out)), ("u", "x", "{oops"), ("v", "x", None), ("w", None, '{"a": 55}')], "target_id string, source_text string, output string")
    flags = {(r.target_id, r.field, r.number) for r in audit.audit_generated_text(df, generative=("story",)).collect()}
    assert flags >= {("t", "note", "77"), ("t", "big", "1234567890123")} and not {f for f in flags if "story" in f[1] or f[1] == "descriptionEn"}
    assert audit.audit_generated_text(df.where("false")).count() == 0


def test_leaves_need_no_job_while_planned(spark):
    deep = "[" * 300 + '"77"' + "]" * 300
    df = spark.createDataFrame([(1, "", deep), (2, "", "[" * 100_000)], "target_id int, source_text string, output string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("leaves", "none")
    flags = audit.audit_generated_text(df)
    assert len(tracker.getJobIdsForGroup("leaves")) == 0
    assert [(r.target_id, r.number, len(r.field)) for r in flags.collect()] == [(1, "77", 900)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_types_inside_warnings(spark):
    copy = {"descriptionEn": "d" * 20, "itemSpecifics": {}, "confidence": 1}
    given = [[{"field": 5, "message": 7}], [{"field": "f", "message": 7}], [{"field": "f", "message": "m", "more": 1}], [{"field": "f"}], ["text"], [], [{"field": "f", "message": None}], [{"field": "", "message": "x" * 500}]]
    df = spark.createDataFrame([(i, json.dumps(copy | {"warnings": w})) for i, w in enumerate(given)], "id int, output string")
    got = [bool(r.issues) for r in audit.validate_copy(df).orderBy("id").collect()]
    assert got == [True, True, False, True, True, False, True, False]


def test_patterns_are_those_of_the_engine(spark):
    assert not rules.valid("(?P<n>..)") and not rules.valid("(") and rules.valid("(?<n>..)") and rules.valid("[0-9]++")


def test_lines_of_several_splits_keep_their_numbers(spark, tmp_path):
    one = "".join(f"name {i},カード{i}{'x' * (i % 50)}\r\n" if i % 7 else "\n" for i in range(5000))
    files = {"a.txt": one, "b.txt": "x\n\ny", "c.txt": "", "d.txt": "\n", "e.txt": "last"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for name, text in files.items():
            df = src.read_lines(spark, str(tmp_path / name))
            got = sorted((r.line_no, r.line) for r in df.collect())
            want = [(i, line.removesuffix("\r")) for i, line in enumerate(text.split("\n"), 1)] if text else []
            assert got == want, name
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
        assert src.read_lines(spark, str(tmp_path)).count() == sum(len(t.split("\n")) for t in files.values() if t)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_generation_log(spark):
    good = json.dumps({"descriptionEn": "d" * 20, "itemSpecifics": {"n": "no 77"}, "confidence": 0.9})
    rows = [("1", "m", "copy", "p", "has 77", good), ("2", "m", "copy", "p", "none", good), ("3", "m", "copy", "q", "none", "oops"), ("4", "m", "copy", None, None, None)]
    runs = spark.createDataFrame(rows, "run_id string, model string, purpose string, prompt string, source_text string, output string")
    log = {r.run_id: r for r in audit.generation_log(runs).collect()}
    assert [(log[i].schema_valid, log[i].n_flags, log[i].needs_review, log[i].output) for i in "1234"] == [(True, 0, False, good), (True, 1, True, good), (False, 0, True, "oops"), (False, 0, True, None)]
    assert log["1"].prompt_hash == log["2"].prompt_hash != log["3"].prompt_hash and log["2"].flags[0].number == "77"


def test_canonical_works_out_each_part_once(spark, capsys):
    spark.createDataFrame([("https://s.jp/カ/../b?q=1",)], "u string").select(urls.canonical(F.col("u")).alias("c")).explain("extended")
    plan = capsys.readouterr().out
    analyzed = plan[plan.index("Analyzed") : plan.index("Optimized")]
    assert analyzed.count("aggregate(") == 1 and analyzed.count("array_sort(") == 1


def test_elements_leave_in_bounded_frames(spark):
    page = "<ul>" + "<li class=a><a href=x>1</a></li>" * 700 + "</ul>"
    sent = list(pages._handed(iter([[1, i] for i in range(9000)]), ["page_id", "n"]))
    assert [len(f) for f in sent] == [4096, 4096, 808]
    df = spark.createDataFrame([(i, "https://s.jp/", page) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    assert pages.page_elements(df).groupBy("page_id", "tag").count().where("tag = 'li' and count = 700").count() == 9
    config = pages.CardConfig(pages.Selector("li"), {"name": pages.Selector("a")})
    assert pages.extract_listing_cards(df, config).where("name = '1'").count() == 6300


def test_total_cost_is_the_sum_of_its_columns(spark, capsys):
    """To the last digit, in fewer steps than there are columns."""
    offers = spark.range(300).selectExpr(
        "id", *(f"cast(id * {n} / 7 as decimal(20,6)) as {c}" for n, c in ((1013, "purchase_price"), (11, "domestic_shipping_jpy"), (3, "handling_jpy"), (97, "selling_price"))), "cast(149.123456789 + id as decimal(20,10)) as fx_rate",
    )
    kinds = (profit.Terms(), profit.Terms(category_fee="13.251234", insurance="120", other="7.5", mode="SELLER_PAID", de_minimis="150", duty="5.123", import_tax="20"))
    for terms in kinds:
        df = profit.profit_scenarios(offers, terms)
        plain = money.total([F.col(f"cost_{n}") for n in profit.COSTS])
        assert df.where(~F.col("total_cost").eqNullSafe(plain)).count() == 0 and df.where("total_cost > 0").count() > 800
    profit.profit_scenarios(offers).select("total_cost").explain("extended")
    plan = capsys.readouterr().out
    assert plan[plan.index("== Optimized") :].split("== Physical")[0].count(" * ") < 12
