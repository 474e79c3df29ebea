import hashlib
import random
import re

from kontor.llm.substring_dedup import levels, substring_dedup


def brute(rows, window):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(docs):
        for a in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][a : a + window]), i)
    out = {}
    for i, words in docs.items():
        gone = set()
        for a in range(len(words) - window + 1):
            if first[tuple(words[a : a + window])] < i:
                gone |= set(range(a, a + window))
        kept = " ".join(w for a, w in enumerate(words) if a not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def pieces(seed):
    """Texts that share passages, overlap them, repeat inside themselves, and are copies of each other."""
    rng = random.Random(seed)
    stock = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(4, 40))] for _ in range(8)] + [["ha"] * 30]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(stock) if rng.random() < 0.7 else [f"x{rng.randint(0, 500)}" for _ in range(rng.randint(1, 9))]
            words += part[rng.randint(0, 3) :]
        rows.append((i * 3, rng.choice((" ", "\n", "  ")).join(words)))
        if rng.random() < 0.2:
            rows.append((i * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_against_all_windows(spark):
    for seed, window, start in ((1, 10, 25), (2, 13, 3), (3, 50, 25), (4, 50, 5)):
        rows = pieces(seed)
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, start=start).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, window)


def test_levels_double():
    assert levels(50) == [12, 25, 50] and levels(50, 25) == [25, 50] and levels(50, 5) == [6, 12, 25, 50] and levels(13, 3) == [3, 6, 13] and levels(10) == [10]


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [("1", a), ("1", a), ("2", b), ("2", a + " x"), ("3", b + " y"), (None, a)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    found = sorted((r.doc_id or "", r.n_words, r.n_removed) for r in got)
    assert found == [("", 60, 0), ("1", 60, 0), ("1", 60, 0), ("2", 60, 60), ("2", 61, 60), ("3", 61, 0)]


def test_odd_rows(odd, none):
    got = substring_dedup(odd).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(odd.select("doc_id", "text").collect(), 50)
    assert substring_dedup(none).count() == 0
