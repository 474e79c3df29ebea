import math
import random

import numpy as np
import pytest

from kontor.llm.negatives import hard_negatives, products, quantised

BOUND = 2**63


def whole(x):
    return min(max(int(math.floor(256.0 * x)), -BOUND), BOUND - 1) if abs(x) < 1e305 else (-BOUND if x < 0 else BOUND - 1)


def brute(rows, positives, most, low, high):
    """All pairs in plain Python."""
    good = [(i, lab, [whole(x) for x in v]) for i, lab, v, _ in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    wanted = {i for i, lab, v, a in rows if a}
    anchors = {}
    for i, lab, v, a in rows:
        if a and None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in anchors.items():
        assert i in wanted
        own = [whole(x) for x in v]
        scored = [(min(max(sum(map(lambda p, q: p * q, own, w)), -BOUND), BOUND - 1), j, m) for j, m, w in good if j != i and len(w) == len(own)]
        best = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p, pos, _ in [s for s in best if s[2] == lab][:positives]:
            fits = [s for s in best if s[2] != lab and low * p <= 100 * s[0] <= high * p][:most]
            out += [(i, pos, k + 1, j, p, s) for k, (s, j, _) in enumerate(fits)]
    return sorted(out, key=str)


def table(spark, rows, kind="long", label="int"):
    df = spark.createDataFrame(rows, f"id {kind}, label {label}, vector array<double>, anchor boolean").repartition(3)
    return df.selectExpr("*", "1 as number", "'x' as a", "2 as r", "3 as position", "4 as rank")  # names that the operator uses inside


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, d in ((-166, 167, 64), (0, 2, 1), (-5, -2, 7), (-(2**20), 2**20, 33), (-(2**33), 2**33, 3)):
        a, r = (rng.integers(low, high, (n, d)) for n in (5, 17))
        got = np.concatenate(list(products(a, r, held=40)))
        want = a.astype(object) @ r.astype(object).T
        assert got.shape == (5, 17) and (got.astype(object) == np.clip(want, -BOUND, BOUND - 1)).all()
    wide = quantised(np.array([[1e300, -1e300, 0.5]]))
    assert wide.tolist() == [[BOUND - 1, -BOUND, 128]]


@pytest.mark.parametrize("blocks", [(2048, 32768), (2, 7)])
def test_against_all_pairs(spark, blocks):
    pick = random.Random(3)
    rows = [(i, pick.randrange(3), [round(pick.uniform(-0.2, 1), 1) for _ in range(6)], i % 10 == 0) for i in range(90)]
    rows += [(200 + i, 1, rows[5][2], False) for i in range(12)]  # ties
    rows += [rows[7], rows[7], (7, 2, rows[8][2], False), (10, 0, rows[9][2], True)]  # repeated ids
    rows += [(300, None, rows[1][2], True), (None, 1, rows[1][2], True), (301, 1, None, True), (302, 1, [1.0, None], False)]
    rows += [(303, 1, [float("nan")] * 6, True), (304, 2, [float("inf")] * 6, False), (305, 1, [], True), (306, 1, [], False), (307, 2, [], False)]
    rows += [(310, 1, [0.5, 0.5], True), (311, 1, [0.9, 0.4], False), (312, 2, [0.3, 0.3], False)]
    want = brute(rows, 5, 10, 30, 90)
    got = result(hard_negatives(table(spark, rows), anchors_held=blocks[0], rows_held=blocks[1]))
    assert got == want and len(got) > 100 and {r[0] for r in got} >= {0, 310}
    if blocks[0] == 2:
        want = brute(rows, 2, 3, 10, 100)
        assert result(hard_negatives(table(spark, rows), positives=2, negatives=3, low=10, high=100)) == want


def test_wide_numbers_labels_and_ids_of_other_types(spark):
    pick = random.Random(4)
    rows = [(f"v{i:02}", pick.choice("xyz"), [pick.uniform(-1e12, 1e12) for _ in range(3)], i < 4) for i in range(40)]
    rows += [("w1", "x", [1e306, 1.0, -1e306], True), ("w2", "y", [1e18, 1e18, 0.0], False), ("w3", "x", [1e308, 1e18, 0.0], False)]
    assert result(hard_negatives(table(spark, rows, "string", "string"))) == brute(rows, 5, 10, 30, 90)


def test_nothing_to_mine(spark):
    none = table(spark, [(1, 1, [1.0], True)]).where("id < 0")
    assert hard_negatives(none).count() == 0
    assert hard_negatives(table(spark, [(1, 1, [1.0], True), (2, 2, [1.0], False)])).count() == 0  # no positive
    assert hard_negatives(table(spark, [(1, 1, [1.0], False), (2, 2, [1.0], False)])).count() == 0  # no anchor
    assert hard_negatives(none).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

