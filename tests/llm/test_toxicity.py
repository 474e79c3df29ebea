import random
import re
import zlib

import numpy as np
import pyarrow as pa

from kontor.llm import queries, toxicity
from kontor.llm.flat import chunks, word_hashes
from kontor.llm.toxicity import LISTS, NEGATION, REPORT, TARGET, THREAT, THREATENED, Grammar, Product, cover, machines

SF = "/root/testdata/sf0.01"


def grammar():
    return Grammar(np.array([0, 4]), np.concatenate((word_hashes(["idiot"]), word_hashes(["scum"]))), np.array([2.0, 1.0]))


def features(*texts):
    (chunk,) = chunks(pa.record_batch([pa.array(texts)], names=["text"]))
    return grammar().features(chunk)


def test_clauses_rather_than_words():
    plain, aimed, denied, said = features("he is. An idiot came", "you idiot", "she is not an idiot", "they said, he wrote idiot")[:, 0]
    assert aimed > plain == 2.0 > said > denied > 0
    apart = features("not at all. A real idiot came")[0, 0]
    assert apart == 2.0  # a clause of its own is out of the negation's reach


def test_beginnings_and_threats():
    f = features("scummy thing", "scum", "I will kill you")
    assert f[0, 0] == 1.0 and f[1, 0] == 0.0  # a beginning needs more behind it
    assert f[2, 5] > 0 and f[2, 0] == THREATENED
    time, eggs, denied, later = features("we kill time", "we beat eggs", "i will not kill you", "kill time with me, you said")
    assert not time.any() and not eggs.any() and not later.any()
    assert denied[0] == THREATENED / 2 and denied[3] == 1


def test_negated_share():
    assert features("you are not an idiot", "she is not an idiot", "not that. She is an idiot")[:, 3].tolist() == [1, 1, 0]


WORDS = {w: c for c, ws in LISTS.items() for w in ws.split() if w.isascii()}


def plain(text):
    """The features by rules over words: how far back a negation or a threat is, whether a target, a report or an insult came before."""
    best = total = number = negated = reported = threats = 0
    for clause in re.split(r'[.!?;,:\n|"()]', text):
        words = re.findall("[a-z0-9]+", clause)
        score = threat = 0
        no = aim = None
        target = report = insult = matched = denied = spoken = False
        for i, w in enumerate(words):
            weight = 2.0 if w == "idiot" else 1.0 if w.startswith("scum") and len(w) > 4 else 0
            kind = "insult" if weight else WORDS.get(w)
            damped = (0.5 if no is not None and i - no <= 3 else 1) * (0.7 if report else 1)
            if kind == "insult" or kind == TARGET and aim is not None and i - aim <= 3:
                matched, denied, spoken = True, denied or damped in (0.5, 0.35), spoken or report
                if weight:
                    score += weight * damped * (1.1 if insult else 1) * (1.3 if target else 1)
                    insult, no = True, None
                else:
                    threat += damped
                    aim = None
            target |= kind == TARGET
            report |= kind == REPORT
            no = i if kind == NEGATION else no
            aim = i if kind == THREAT else aim
        if matched:
            score += THREATENED * threat
            best, total, number = max(best, score), total + score, number + 1
            negated, reported, threats = negated + denied, reported + spoken, threats + threat
    n = max(1, number)
    return [best, np.log1p(total), np.log1p(number), negated / n, reported / n, np.log1p(threats)]


def test_features_against_rules_over_words():
    rng = random.Random(3)
    stock = ["idiot", "scummy", "scum", "kill", "beat", "you", "they", "not", "never", "said", "wrote", "the", "a", "thing", "ok", ".", ",", "\n"]
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert np.allclose(features(*texts), [plain(t) for t in texts])


def test_score_is_logistic_in_the_features():
    own = grammar()
    own.logit = np.array([-1.0, 0.5, 0.2, 0.1, -0.3, -0.2, 0.7])
    x = features("you idiot", "fine")
    assert np.allclose(own.score(x), [1 / (1 + np.exp(-(own.logit[0] + sum(a * b for a, b in zip(own.logit[1:], r))))) for r in x])


def test_product_machine_is_the_parts_side_by_side():
    product = Product(machines())
    following, factor = product.following, product.factor
    rng = np.random.default_rng(1)
    for _ in range(200):
        state, parts = 0, [0] * 5
        for symbol in rng.integers(0, 6, 12):
            steps = [m.step(s, int(symbol)) for m, s in zip(machines(), parts, strict=True)]
            parts = [s for s, _ in steps]
            assert np.isclose(factor[state, symbol], np.prod([f for _, f in steps]))
            state = following[state, symbol]


def test_cover_takes_few():
    found = [[0, 1], [0, 2], [0], [3], [1]]
    assert cover(found, np.array([1, 1, 1, 1, 0]), 4, times=1) == [0]


def test_held_out_accuracy(spark):
    rows = queries.op1_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, 0), (7, 0), (7, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r.score for r in toxicity.toxicity(odd, labels).collect()}
    assert len(rows) == odd.count() and rows[0] == rows[1] <= min(rows.values()) and rows[4] == rows[5]
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.where("toxic = 0")).collect()} == {0.0}
