"""Bands of whole numbers, whose bounds are places themselves, against all pairs and without a sort."""

import random

from pyspark.sql import functions as F

from kontor.operators import bands
from kontor.operators.bands import band_join

RULES = "rid long, country long, low long, high long"


def order():
    return [F.col("country").isNull(), F.coalesce(F.col("high") - F.col("low"), F.lit(2**40)), F.col("rid")]


def best(rules, c, v):
    fits = [r for r in rules if None not in (v, r[2]) and r[2] <= v and (r[3] is None or v < r[3]) and r[1] in (None, c)]
    return min(fits, key=lambda r: (r[1] is None, r[3] - r[2] if r[3] is not None else 2**40, r[0] is not None, r[0] or 0), default=(None,) * 4)


def test_whole_bounds(spark, monkeypatch):
    """Values between, below and past all bounds; with a place for each number, and none; ranks as numbers and as structs."""
    pick = random.Random(5)
    rules = [(i, pick.choice([None, 0, 1]), low := pick.randrange(-300, 2000), pick.choice([None, *[low + pick.choice([-1, 0, 1, 2, 7, 64, 900])] * 9])) for i in range(300)]
    rules += [(None, 1, -40, 90), (301, 0, None, 5), (302, 1, 1500, 1501), (302, 1, 1500, 1501)]
    values = [None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300, -300.0, -299.5, *(pick.randrange(-1500, 14000) / 4 for _ in range(400))]
    facts = [(i, pick.choice([None, 0, 1, 2]), v) for i, v in enumerate(values)]
    f, b = spark.createDataFrame(facts, "id int, c long, v double"), spark.createDataFrame(rules, RULES)
    past = lambda v: 1e301 if v != v else v  # a NaN is past all numbers
    want = {i: best(rules, c, v if v is None else past(v)) for i, c, v in facts}
    for depth, coded, most in ((32, 128, 1 << 62), (3, 128, 1 << 62), (32, 0, 1 << 62), (32, 128, 1)):
        for name, size in (("DEPTH", depth), ("CODED", coded), ("WHOLE", most)):
            monkeypatch.setattr(bands, name, size)
        got = {r.id: (r.rid, r.country, r.low, r.high) for r in band_join(f, b, ["id"], "v", "low", "high", {"c": "country"}, order(), 10).collect()}
        assert got == want, (depth, coded, most)


def test_nodes_keep_their_first_rule_without_a_sort(spark, capsys):
    """Rows of all nodes of all rules would be sorted, and written to disk where memory ends, before they are fewer."""
    rules = spark.range(5000).selectExpr("id as rid", "nullif(id % 3, 2) as country", "id % 977 as low", "id % 977 + 50 as high")
    facts = spark.range(500).selectExpr("id", "id % 2 as c", "id * 2.5d as v")
    got = band_join(facts, rules, ["id"], "v", "low", "high", {"c": "country"}, order(), 10).select("id", "rid")
    got.explain()
    plan = capsys.readouterr().out
    assert "SortAggregate" not in plan and plan.count("Scan ExistingRDD") == 0
    assert got.where("rid is not null").count() > 300
