import hashlib
import random

import numpy as np
import pytest

from kontor.llm import suffix_dedup as module
from kontor.llm.flat import Chunk
from kontor.llm.suffix_dedup import compare, suffix_dedup


def brute(rows, width):
    docs = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(docs):
        for a in range(len(docs[i]) - width + 1):
            first.setdefault(docs[i][a : a + width], i)
    out = {}
    for i, data in docs.items():
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - width + 1):
            if first[data[a : a + width]] < i:
                gone[a : a + width] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(20, 200))) for _ in range(8)] + ["ha" * 40, "\0" * 60]
    rows = []
    for i in range(70):
        t = "".join(
            rng.choice(stock)[rng.randint(0, 9) :] if rng.random() < 0.7 else "".join(rng.choice("xyzü") for _ in range(rng.randint(1, 30)))
            for _ in range(rng.randint(0, 5))
        )
        rows.append((i * 2, t))
        if rng.random() < 0.2:
            rows.append((i * 2 + 1, t))
    rng.shuffle(rows)
    return rows


def test_against_all_strings(spark):
    for seed in (1, 2):
        rows = texts(seed)
        got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, 50)


def test_split_leads_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET", 20)
    monkeypatch.setattr(module, "FULL", 0.1)
    monkeypatch.setattr(module, "PART", 2000)
    monkeypatch.setattr(module, "RANGE", 3000)
    monkeypatch.setattr(module, "SMALL", 8)
    monkeypatch.setattr(module, "ROWS", 16)
    rows = texts(3)
    leads = []
    build = module.Splitters.__init__
    monkeypatch.setattr(module.Splitters, "__init__", lambda self, *a: leads.append(self) or build(self, *a))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(leads[0].heavy) and len(leads[0].cuts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, 50)


def test_pieces_of_a_long_text_have_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 900, 30, 0, 400, 2000)]
    chunk = Chunk(slice(0, 6), np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    whole = module.Scan(chunk, 50)
    monkeypatch.setattr(module, "SCAN", 333)
    pieces = module.Scan(chunk, 50)
    assert whole.at.tolist() == pieces.at.tolist() and whole.key.tolist() == pieces.key.tolist() and whole.text.tolist() == pieces.text.tolist()


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(module, "SMALL", 4)
    words = np.random.default_rng(1).integers(0, 4, (3000, 5)).astype(np.uint64)
    order = module.multikey_quicksort(words)
    assert sorted(order.tolist()) == list(range(3000))
    assert words[order].tolist() == sorted(words.tolist())


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a" * 60), (1, "a" * 60), (2, "a" * 60 + "b"), (None, "a" * 60), (3, "c" * 70), (3, "d" * 70), (4, "c" * 60 + "-")]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 0, 1), (1, 0, 2), (2, 60, 1), (3, 0, 2), (4, 60, 1)]
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.n_removed), []).append(r)
    assert {(i, n): len(x) for (i, n), x in found.items()} == {(i, n): k for i, n, k in want}
    with pytest.raises(TypeError):
        suffix_dedup(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_compare_looks_left_and_right():
    table = np.frombuffer(b"abcdefgh" b"xbcdefgh" b"abcdefgx", np.uint8).reshape(3, 8)  # 3 before the anchor, 5 from it
    full = np.full(3, 3), np.full(3, 5)
    masks = compare(np.array([1, 2, 3]), table, *full, 5)
    assert masks.tolist() == [0, 0b111, 0b1110]


def test_odd_rows(odd, none):
    got = suffix_dedup(odd).collect()
    want = brute(odd.select("doc_id", "text").collect(), 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup(none).count() == 0
