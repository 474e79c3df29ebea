import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kontor.llm import ranked_search as module
from kontor.llm.ranked_search import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    """Every document against every query, in plain Python."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def table(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"id {kind}, text string").repartition(3)
    return df.selectExpr("*", "1 as number", "'x' as class", "2 as size", "3 as floor", "4 as score")  # names that the operator uses inside


def result(df):
    return sorted(tuple(r) for r in df.collect())


def corpus():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ähre", "日本", "x_y", "A1"]
    text = lambda n: " ".join(words[min(int(pick.expovariate(0.02)), 303)] for _ in range(n))
    docs = [(i, text(pick.choice([1, 5, 30, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)]  # ties beyond the 50th place
    docs += [(2000, None), (2001, ""), (2002, " \n\t-_!"), (2003, "w1 " * 30_000), (2004, text(40_000)), (2004, "w2 w3"), (None, "w1 w2 rare")]
    items = [(i, text(25)) for i in range(25)] + [(30, docs[3][1]), (31, None), (32, "-"), (33, "unheard"), (34, "W1 w1 w1"), (None, "w1"), (35, "w250"), (35, "w200 rare Ähre 日本")]
    return docs, items


@pytest.mark.parametrize("small", [{}, {"items_held": 5, "piece": 900, "seeds": 60}, {"items_held": 5, "piece": 900, "seeds": 60, "vocabulary_held": 0}])
def test_against_every_document(spark, small):
    docs, items = corpus()
    got = result(ranked_search(table(spark, docs), table(spark, items), **small))
    assert got == brute(docs, items) and len(got) > 500


def test_fewer_places_prune_more(spark, monkeypatch):
    docs, items = corpus()
    pruned = []
    real = module.longest
    monkeypatch.setattr(module, "longest", lambda kind: pruned.append(kind) or real(kind))
    got = result(ranked_search(table(spark, docs), table(spark, items), top=2, seeds=100, piece=2000))
    assert got == brute(docs, items, 2) and pruned


def test_bounds_never_lose():
    rng = np.random.default_rng(2)
    for _ in range(20):
        held = np.unique(rng.integers(0, 400 * 30, 3000))
        place, term = held // 30, held % 30
        imp = rng.integers(1, 10**6, len(place))
        norm = np.sqrt(np.bincount(place, imp.astype(float) ** 2, 400))
        order = np.argsort(-norm, kind="stable")
        back = np.empty(400, int)
        back[order] = np.arange(400)
        o = np.lexsort((back[place], term))
        names, first = np.unique(term[o], return_index=True)
        ends = np.append(first, len(o)).tolist()
        weights = rng.integers(1, 9000, 20)
        q = module.Query(np.arange(20), weights, 0, 7)
        q.search(order, norm[order], back[place][o], imp[o], dict(zip(names.tolist(), zip(ends[:-1], ends[1:], strict=True), strict=True)), np.arange(400))
        full = np.zeros(400, np.int64)
        np.add.at(full, place, np.where(term < 20, np.append(weights, np.zeros(10, int))[term], 0) * imp)
        want = np.lexsort((np.arange(400), -full))[:7]
        assert q.docs.tolist() == want.tolist() and q.scores.tolist() == full[want].tolist()


def test_ids_of_another_type(spark):
    docs, items = corpus()
    docs, items = [(f"d{i:05}", t) for i, t in docs if i is not None], [(f"q{i}", t) for i, t in items if i is not None]
    assert result(ranked_search(table(spark, docs, "string"), table(spark, items, "string"))) == brute(docs, items)


def test_empty_sides(spark, odd, none):
    docs, items = corpus()
    assert ranked_search(table(spark, docs), table(spark, items).where("id < 0")).count() == 0
    assert ranked_search(table(spark, docs).where("id < 0"), table(spark, items)).count() == 0
    assert ranked_search(table(spark, [(1, None)]), table(spark, items)).columns == ["item_id", "rank", "doc_id", "score"]
    mine = odd.select("doc_id", "text").withColumnRenamed("doc_id", "id")
    rows = [tuple(r) for r in mine.collect()]
    assert result(ranked_search(mine, mine)) == brute(rows, rows)
