import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.llm import quality_rules as q

from .conftest import SF, TEXTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    counts = Counter(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_distinct": len(counts),
        "n_top": max(counts.values(), default=0),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_letters": len(re.findall(r"[A-Za-z]|[^\x00-\x7F]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_marks": len(re.findall(r"[!-/:-@\[-`{-~]", text)),
        "longest": max(map(len, words), default=0),
    }


EXTRA = ["a b c a b c", "x x x x", "x\nx\n x\nx \r\nx \r\n\n\n", "A#b c&&&\tq|<>$%*", "one two three one two", "é é 日本　語 " * 3, "end\n", "\n", "a\x0bb\x0cc"]


def test_counts_against_plain_python(spark):
    pick = random.Random(2)
    rows = list(enumerate(TEXTS + EXTRA + ["".join(pick.choice("ab \n\t#Aé1") for _ in range(pick.randrange(400))) for _ in range(60)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r for r in q.statistics(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        assert {c: got[i][c] for c in want} == want, (i, text)
        assert got[i].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert got[i].symbol_share == (want["n_symbols"] / want["n_words"] if want["n_words"] else 0)


def test_counts_of_a_whole_table(docs):
    got = {r.id: r for r in q.statistics(docs).collect()}
    for r in docs.collect():
        want = brute(r.text)
        assert {c: got[r.doc_id][c] for c in want} == want


def made(n=1500, noise=0.0):
    rng = np.random.default_rng(4)
    table = {f: rng.random(n) for f in q.FEATURES}
    bad = (table["symbol_share"] > 0.8) | ((table["upper_share"] > 0.7) & (table["word_length"] < 0.4))
    return table, bad ^ (rng.random(n) < noise), bad


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_rules_are_found(noise):
    table, told, bad = made(noise=noise)
    rules = q.learn(table, told)
    assert 2 <= len(rules) <= 10 and max(map(len, rules)) >= 2
    said = np.zeros(len(bad), bool)
    for rule in rules:
        said |= q._holds(rule, table, len(bad))
    assert (said == bad).mean() > 0.97
    assert {c.feature for r in rules[:1] for c in r} <= {"symbol_share", "upper_share", "word_length"} | (set(q.FEATURES) if noise else set())


def test_growing_and_pruning():
    table, _, bad = made()
    rule = q.grow(table, bad & (table["symbol_share"] <= 0.8))
    assert {c.feature for c in rule} >= {"upper_share", "word_length"}
    noise = q.Condition("digit_share", True, 0.5)
    good = (q.Condition("upper_share", True, 0.7), q.Condition("word_length", False, 0.4))
    assert q.prune((*good, noise), table, bad) == good  # the shortest of equal balance


def test_nothing_to_learn():
    table, _, bad = made(60)
    assert q.learn(table, np.zeros(60, bool)) == [] and q.learn(table, np.ones(60, bool)) == []
    assert q.learn({f: np.empty(0) for f in q.FEATURES}, np.empty(0, bool)) == []
    random_labels = np.random.default_rng(1).random(60) < 0.3
    assert len(q.learn({f: np.zeros(60) for f in q.FEATURES}, random_labels)) == 0


def test_the_expression_says_what_the_rules_say(spark, docs):
    rules = [(q.Condition("n_words", True, 300.0), q.Condition("word_length", False, 4.5)), (q.Condition("longest", True, 12.0),)]
    rows = q.statistics(docs).withColumn("rule", q.verdict(rules)).toPandas()
    table = {f: rows[f].to_numpy(float) for f in q.FEATURES}
    first, second = (q._holds(r, table, len(rows)) for r in rules)
    assert (rows["rule"].to_numpy() == np.where(first, 1, np.where(second, 2, 0))).all() and set(rows["rule"]) == {0, 1, 2}
    assert "CASE WHEN" in str(q.verdict(rules)) and str(rules[0][1]) == "word_length <= 4.5"


def test_held_out_documents(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = q.quality_rules(docs, labels.select("doc_id", "quality"))
    told = out.join(labels, "doc_id").where("held_out and not base_failed").select("kept", "quality").collect()
    assert len(told) > 500 and sum(r.kept == (r.quality == 1) for r in told) >= 0.97 * len(told)
    assert out.where("base_failed and kept").count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(11)] + [(3, 0, "y"), (None, 0, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    out = q.quality_rules(odd, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS) and not got[0].kept and got[0].n_words == 0 and got[8].n_words == 30_000 and got[8].kept and not got[10].kept
    assert q.quality_rules(none, labels).count() == 0
    assert q.quality_rules(odd, labels.where("doc_id < 0")).where("kept").count() == 1
    named = spark.createDataFrame([(None, "w " * 60), ("a", " ".join(f"w{i}" for i in range(60))), ("a", "b")], "doc_id string, text string")
    rows = q.quality_rules(named, spark.createDataFrame([("a", 0)], "doc_id string, quality int")).collect()
    assert len(rows) == 3 and all(r.held_out is not None and r.kept is not None for r in rows)
    assert {r.held_out for r in rows} == {False, zlib.crc32(b"a") % 5 == 0}
