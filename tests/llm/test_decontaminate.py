import random
import re
from itertools import combinations

from kontor.llm import decontaminate as module
from kontor.llm.decontaminate import MISS, SPAN, clean, masks, overlaps


def brute(docs, items):
    """(id, item) to (windows of the item, first word, least misses), all windows against all."""

    def words(text):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = {}
    for i, text in docs:
        w = words(text)
        for j, other in items:
            v = words(other)
            span, allowed = (SPAN, MISS) if len(v) >= SPAN else (len(v), 0)
            hits = [
                (b, a, n)
                for a in range(len(w) - span + 1)
                for b in range(len(v) - span + 1)
                if span and (n := sum(x != y for x, y in zip(w[a : a + span], v[b : b + span]))) <= allowed
            ]
            if hits:
                out[i, j] = len({h[0] for h in hits}), min(h[1] for h in hits), min(h[2] for h in hits)
    return out


def test_masks_cover_every_set_of_misses():
    kept = [set(m.tolist()) for m in masks(SPAN, MISS)]
    assert all(any(not set(miss) & k for k in kept) for miss in combinations(range(SPAN), MISS))


def tables(spark):
    rng = random.Random(4)
    items = [(j, " ".join(f"b{rng.randint(0, 300)}" for _ in range(n))) for j, n in enumerate((30, 20, 13, 12, 5, 1, 0, 25))]
    items.append((9, items[1][1]))
    docs = []
    for i in range(60):
        filler = [f"d{rng.randint(0, 300)}" for _ in range(rng.randint(0, 30))]
        passage = (items[rng.randrange(8)][1] or "b1").split()
        for _ in range(rng.randint(0, 4)):
            passage[rng.randrange(len(passage))] = "x"
        docs.append((i, " ".join(filler[:7]) + " " + ", ".join(passage).upper() + ". " + " ".join(filler[7:])))
    docs.append((60, None))
    return docs, items, spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string")


def test_against_all_windows(spark):
    docs, items, left, right = tables(spark)
    want = brute(docs, items)
    assert len(want) > 20
    for held in (1 << 20, 0):  # with the shortcut, and by the shuffle alone
        got = {(r.id, r.item): (r.n_windows, r.first_word, r.least_misses) for r in overlaps(left, right, held).collect()}
        assert got == want


def test_clean_keeps_columns_and_other_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog near the river bank today"), (2, None)], "item long, text string")
    kept = clean(odd, items)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 7, 8, 9, 10}
    assert clean(none, items).count() == 0
    assert clean(odd, items.where("item = 2")).count() == odd.count()


def test_a_large_benchmark_shuffles_only_what_passes(spark):
    """A million item windows: of the documents' windows the true ones pass, and few others."""
    words = "transform(sequence(0, 30), i -> concat('{}', hash(id, i) % 100000))"
    items = spark.range(9000).selectExpr("id as item", f"concat_ws(' ', {words.format('b')}) as text")
    docs = spark.range(4000).selectExpr("id", f"concat_ws(' ', {words.format('d')}) as text")
    leak = items.where("item % 1000 = 0").selectExpr("item + 10000 as id", "concat('x y z ', text, ' w') as text")
    tests = items.mapInArrow(module._items, "item long, hash long, item_at int, item_words array<long>")
    n = tests.count()
    assert n > 10**6
    mine = module.document_windows(docs.union(leak), [], module.Bitmap(tests, n)).groupBy((module.F.col("id") >= 10_000).alias("leak")).count().collect()
    passed = {r.leak: r["count"] for r in mine}
    assert passed[True] >= 9 * 19 * 6 and passed.get(False, 0) < 0.05 * 4000 * 19 * 6
    got = {(r.id, r.item) for r in overlaps(docs.union(leak), items).collect()}
    assert got == {(i * 1000 + 10_000, i * 1000) for i in range(9)}
