import math
import re
import zlib
from collections import Counter

import numpy as np

from kontor.llm import hmm, queries
from kontor.llm.hmm import Model, Symbols, language_model

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows):
    """n_tokens, n_known, N and the base score, by the stated sums."""
    c = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {
        i: (len(w := tokens(text)), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 1) / (n + (v + 1))) for t in w))
        for i, text in rows
    }


def same(got, want):
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        a, b, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and math.isfinite(r.score)


def small():
    symbols = Symbols(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8), np.zeros(256, int), np.zeros(256, int), 0)
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    emit = norm(rng.random((hmm.STATES, symbols.size))).T
    return Model(symbols, norm(rng.random(hmm.STATES)), norm(rng.random((hmm.STATES, hmm.STATES))), emit), rng


def plain(model, sequence):
    alpha = model.start * model.emit[sequence[0]]
    for s in sequence[1:]:
        alpha = alpha @ model.move * model.emit[s]
    return math.log(alpha.sum())


def test_forward_is_the_exact_likelihood():
    model, rng = small()
    sizes = [1, 7, 40, 3, 40]
    flat = rng.integers(0, model.symbols.size, sum(sizes))
    first = np.concatenate(([0], np.cumsum(sizes)))
    got = model.forward(flat, first)
    assert np.allclose(got, [plain(model, flat[a:b]) for a, b in zip(first[:-1], first[1:])])


def test_a_round_never_lowers_the_likelihood():
    model, rng = small()
    flat = rng.choice(12, 400, p=np.arange(1, 13) / 78)
    first = np.array([0, 90, 91, 219, 400])
    segments = np.array([0, 90, 91, 219, 347, 400])  # as training cuts them
    last = model.forward(flat, segments).sum()
    for _ in range(4):
        counts = np.zeros((model.symbols.size, hmm.STATES))
        starts, moves, likely = model.expect(flat, segments, counts)
        assert np.isclose(likely, last)
        assert math.isclose(counts.sum(), len(flat)) and math.isclose(moves.sum(), len(flat) - 5) and math.isclose(starts.sum(), 5)
        whole = np.zeros_like(counts)
        model.expect(flat, first, whole)
        assert np.allclose(whole, counts)
        emit = counts + 1e-12
        model = Model(model.symbols, starts / starts.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
        now = model.forward(flat, segments).sum()
        assert now >= last - 1e-9
        last = now


def test_query_against_brute_force(spark, docs):
    rows = queries.op3_hmm(spark, SF).collect()
    same(rows, brute(docs.select("doc_id", "text").collect()))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # it predicts unseen texts better


def test_odd_rows(odd, none):
    got = language_model(odd.select("doc_id", "text")).collect()
    same(got, brute(odd.select("doc_id", "text").collect()))
    assert language_model(none).count() == 0
    only = odd.where(hmm.held_out())
    same(language_model(only).collect(), brute(only.select("doc_id", "text").collect()))
