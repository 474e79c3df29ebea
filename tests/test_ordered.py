"""Work along a hot key, as-of joins and band joins against windows and all pairs."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kontor.operators import ordered, profit
from kontor.operators.bands import band_join
from kontor.operators.listings import price_moves


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def history(spark, n=3000):
    pick = random.Random(1)
    rows = [(pick.choice([None, "hot", "hot", "hot", f"k{i % 40}"]), pick.randrange(500), i, pick.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, t int, id int, price double").repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_previous_value_equals_the_window(spark, parts):
    df = history(spark)
    want = df.withColumn("before", F.lag("price").over(Window.partitionBy("key").orderBy("t", "id")))
    got = ordered.previous_value(df, ["key"], ["t", "id"], "price", "before", parts)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_a_hot_key_is_spread(spark):
    rows = ordered.dealt(history(spark), ["key"], [F.col("t"), F.col("id")], 12)
    sizes = {r[0]: r[1] for r in rows.where("key = 'hot'").groupBy(ordered.PART).count().collect()}
    assert len(sizes) >= 6 and max(sizes.values()) < 600
    cut = ordered.handed_on(rows, ["key"], [F.col("t"), F.col("id")], F.struct("price"), "p")
    assert cut.count() <= 12  # a row for each boundary at most


def test_moves_with_and_without_spreading(spark):
    df = history(spark).where("key is not null and price is not null")
    assert rows_of(price_moves(df, "key", ["t", "id"], "price")) == rows_of(price_moves(df, "key", ["t", "id"], "price", spread=True))
    none = df.where("t < 0")
    assert price_moves(none, "key", ["t", "id"], "price", spread=True).count() == 0


DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 9])
def test_as_of_join(spark, parts):
    pick = random.Random(2)
    key = lambda: pick.choice([None, 1, 1, 1, 1, pick.randrange(30)])
    time = lambda: pick.choice([None] + [DAY + timedelta(hours=pick.randrange(300))] * 9)
    facts = [(i, key(), time()) for i in range(800)] + [(1, 1, DAY), (1, 1, DAY)]
    profiles = [(i, key(), time(), i % 7) for i in range(250)]
    f = spark.createDataFrame(facts, "id int, k int, at timestamp")
    p = spark.createDataFrame(profiles, "pid int, k int, since timestamp, fee int")
    got = ordered.as_of_join(f, p, ["k"], "at", "since", [F.col("fee"), -F.col("pid")], parts)

    def best(k, at):
        fits = [q for q in profiles if None not in (k, at, q[1], q[2]) and q[1] == k and q[2] <= at]
        return max(fits, key=lambda q: (q[2], -q[3], q[0])) if fits else (None, None, None, None)

    want = [(i, k, at, (b := best(k, at))[0], b[2], b[3]) for i, k, at in facts]
    assert got.columns == ["id", "k", "at", "pid", "since", "fee"] and rows_of(got) == sorted(want, key=str)
    assert ordered.as_of_join(f.where("id < 0"), p, ["k"], "at", "since").count() == 0
    alone = ordered.as_of_join(f, p.where("pid < 0"), ["k"], "at", "since")
    assert alone.count() == len(facts) and alone.where("pid is not null").count() == 0


def test_many_profiles_take_the_join(spark, monkeypatch):
    rows = [(i, DAY + timedelta(hours=7 * (i // 2)), i % 3 > 0, i) for i in range(60)]
    profiles = spark.createDataFrame(rows, "profile_id int, effective_from timestamp, is_active boolean, fee int")
    facts = spark.createDataFrame([(i, DAY + timedelta(hours=i - 5)) for i in range(300)], "id int, at timestamp")
    few = rows_of(profit.profile_as_of(facts, profiles, "at"))
    monkeypatch.setattr(profit, "FEW", 3)
    assert rows_of(profit.profile_as_of(facts, profiles, "at").select("id", "at", "profile_id", "effective_from", "is_active", "fee")) == few


def bands(pick, n):
    out = []
    for i in range(n):
        low = pick.choice([None, Decimal(pick.randrange(-500, 4000)) / 4])
        out.append((i, pick.choice([None, "x", "y"]), low, None if pick.random() < 0.1 or low is None else low + Decimal(pick.choice([-1, 0, 1, 3, 50, 4000])) / 4))
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_band_join(spark, few):
    pick = random.Random(3)
    rules = bands(pick, 300)
    facts = [(i, pick.choice([None, "x", "y", "z"]), pick.choice([None] + [Decimal(pick.randrange(-600, 6000)) / 4] * 9)) for i in range(400)]
    f = spark.createDataFrame(facts, "id int, c string, v decimal(20,6)")
    b = spark.createDataFrame(rules, "rid int, country string, low decimal(20,6), high decimal(20,6)")
    order = [F.col("country").isNull(), F.coalesce(F.col("high") - F.col("low"), F.lit(10**9)), F.col("rid")]
    got = band_join(f, b, ["id"], "v", "low", "high", {"c": "country"}, order, few)

    def best(c, v):
        fits = [r for r in rules if None not in (v, r[2]) and r[2] <= v and (r[3] is None or v < r[3]) and (r[1] is None or r[1] == c)]
        return min(fits, key=lambda r: (r[1] is None, r[3] - r[2] if r[3] is not None else 10**9, r[0])) if fits else (None,) * 4

    assert got.columns == ["id", "c", "v", "rid", "country", "low", "high"]
    assert rows_of(got) == sorted(((*x, *best(x[1], x[2])) for x in facts), key=str)
    any_rule = band_join(f, b, ["id"], "v", "low", "high", None, [F.col("rid")], few)
    want = [(*x, *min(([r for r in rules if None not in (x[2], r[2]) and r[2] <= x[2] and (r[3] is None or x[2] < r[3])]), default=(None,) * 4)) for x in facts]
    assert rows_of(any_rule) == sorted(want, key=str)
    assert band_join(f, b.where("rid < 0"), ["id"], "v", "low", "high", {"c": "country"}, order, few).where("rid is not null").count() == 0


def test_many_bands_are_joined_by_bins(spark, capsys):
    lines = spark.range(100_000).selectExpr("id as rid", "cast(id % 1000 as string) as country", "id * 3 as low", "id * 3 + 1 + id % 90 as high")
    facts = spark.range(2000).selectExpr("id", "cast(id % 1000 as string) as c", "id * 150 as v")
    got = band_join(facts, lines, ["id"], "v", "low", "high", {"c": "country"}, [F.col("rid")])
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = facts.join(lines, (F.col("c") == F.col("country")) & (F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))).groupBy("id").agg(F.min("rid").alias("rid"))
    assert rows_of(got.where("rid is not null").select("id", "rid")) == rows_of(want)


def test_band_join_broadcasts_neither_side(spark):
    """Both sides grow before they meet, which their sizes on disk do not show."""
    facts = spark.range(4000).select("id", (F.col("id") % 977).cast("double").alias("v"), (F.col("id") % 3).alias("c"))
    rules = spark.range(4000).select(F.col("id").alias("rid"), F.nullif(F.col("id") % 4, F.lit(3)).alias("country"), (F.col("id") % 500).alias("low"), F.when(F.col("id") % 2 == 0, F.col("id") % 500 + 400).alias("high"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2mb")  # a row for each range is sent
    try:
        got = band_join(facts, rules, ["id"], "v", "low", "high", {"c": "country"}, [F.col("rid")], 10).select("id", "rid").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    rows = [(r.rid, r.country, r.low, r.high) for r in rules.collect()]
    first = lambda v, c: next((i for i, p, low, high in rows if low <= v and (high is None or v < high) and p in (None, c)), None)
    want = {(v, c): first(v, c) for v, c in {(i % 977, i % 3) for i in range(4000)}}
    assert {r.id: r.rid for r in got} == {i: want[i % 977, i % 3] for i in range(4000)}
