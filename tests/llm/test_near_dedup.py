import random
import re

from kontor.llm import near_dedup as near_dedup_module
from kontor.llm.near_dedup import near_dedup
from kontor.llm.shared import components


def brute(rows):
    """(n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def variants(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((3, 8, 40, 150)))]
        for _ in range(rng.choice((1, 2, 9))):
            copy = [w if rng.random() > 0.02 else f"x{rng.randint(0, 99)}" for w in words]
            rows.append((len(rows), " ".join(copy)))
            words = copy if rng.random() < 0.5 else words
    return rows


def test_against_all_pairs(spark):
    for seed in range(2):
        rows = variants(seed)
        got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = brute(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(seed):
    """Many copies of one text, each edited a little."""
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        words = [f"w{j}" for j in range(80)]
        for at in rng.sample(range(80), 2):
            words[at] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    return rows


def test_edited_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(near_dedup_module, "BLOCK", 20)
    rows = edited(4)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), stars=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in near_dedup(odd).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == brute(odd.select("doc_id", "text").collect())
    assert near_dedup(none).count() == 0
