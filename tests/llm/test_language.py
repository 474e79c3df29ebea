import zlib

import numpy as np
import pyarrow as pa

from kontor.llm import language, queries
from kontor.llm.flat import chunks
from kontor.llm.language import BUCKETS, has_letter, support_vectors, trigrams

SF = "/root/testdata/sf0.01"


def test_trigrams_stay_within_a_text():
    (chunk,) = chunks(pa.record_batch([pa.array(["abcd", "", "ab", "x   y", "ABCD"])], names=["text"]))
    found = trigrams(chunk)
    per = [found[a:b] for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
    assert (per[0] < BUCKETS).sum() == 2 and (per[2] < BUCKETS).sum() == 0
    assert per[0].tolist() == per[4].tolist()


def test_letters():
    (chunk,) = chunks(pa.record_batch([pa.array(["a", "", "12 .", "日", "½ 😀", None])], names=["text"]))
    assert has_letter(chunk).tolist() == [True, False, False, True, False, False]


def test_machine_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = support_vectors(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


def votes(machines, text):
    """The language by counting votes and margins one trigram at a time."""
    clean = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text).encode()
    counts = {}
    for i in range(len(clean) - 2):
        if clean[i : i + 2] != b"  ":
            bucket = (int.from_bytes(clean[i : i + 3], "little") * 2654435761) % 2**32 >> 19
            counts[bucket] = counts.get(bucket, 0) + 1
    size = max(1, sum(counts.values()))

    def winner(names, pairs):
        won, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b, k in pairs:
            margin = sum(n * float(machines.weights[bucket, k]) for bucket, n in counts.items()) / size * language.SCALE + machines.constant[k]
            won[names[a] if margin > 0 else names[b]] += 1
            sums[names[a]] += margin
            sums[names[b]] -= margin
        return max(names, key=lambda c: won[c] + np.tanh(sums[c] / 100) / 2)

    family = winner(*machines.steps[0])
    return winner(*machines.steps[1 + machines.families.index(family)])


def test_predictions_against_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machines = language.learn(docs.select(language.F.col("doc_id").alias("id"), "text", "lang"), sample=60)
    texts = [r.text for r in docs.where("doc_id % 20 = 0 and text is not null").select("text").collect()]
    for chunk in chunks(pa.record_batch([pa.array(texts)], names=["text"])):
        names, _ = machines.predict(chunk)
        letters = has_letter(chunk)
        for i, name in enumerate(names):
            assert name == (votes(machines, texts[chunk.rows.start + i]) if letters[i] else "und")


def test_many_languages_are_all_learnt(spark):
    codes = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [(i, " ".join([c * 3] * 12), c) for i, c in enumerate(codes * 6)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    machines = language.learn(docs)
    assert machines.languages == codes and len(machines.families) == 3
    got = {r.id: r.lang_pred for r in language.predict(docs, machines, "id").collect()}
    assert sum(got[i] == c for i, _, c in rows) >= 0.95 * len(rows)


def test_held_out_accuracy(spark):
    rows = queries.op8_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_odd_rows(odd, none):
    rows = {r.doc_id: r for r in language.language(odd).collect()}
    assert len(rows) == odd.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2))
    assert rows[4].lang_pred == "en"
    assert language.language(none).count() == 0
    nothing = language.language(odd.withColumn("lang", language.F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_a_language_of_a_billion_texts_is_still_learnt(spark):
    """The share of a sample in a huge language is small but not nothing."""
    from pyspark.sql import functions as F

    from kontor.llm.shared import chosen_share

    share = 400 / 5e8
    rows = spark.range(20_000_000).where(chosen_share(F.lit(share * 1000))).count()  # as many as of 2e10 ids, by proportion
    assert 10_000 < rows < 22_000
    assert spark.range(20_000_000).where(chosen_share(F.lit(share))).count() in range(4, 40)


def test_fitting_holds_rows_by_what_they_have():
    rng = np.random.default_rng(1)
    which = [np.sort(rng.choice(BUCKETS, 50, False)).astype(np.uint16) for _ in range(40)]
    values = [rng.random(50).astype(np.float32) for _ in which]
    shares = language.Shares([w.tobytes() for w in which], [v.tobytes() for v in values])
    dense = np.zeros((40, BUCKETS), np.float32)
    for row, w, v in zip(dense, which, values, strict=True):
        row[w] = v
    lang = np.array(["en", "de", "fr", "es"] * 10, object)
    assert (shares[lang == "en"] == dense[lang == "en"].astype(np.float64) * language.SCALE).all()
    a, b = language.Machines(shares, lang), language.Machines(dense.astype(np.float64) * language.SCALE, lang)
    assert (a.weights == b.weights).all() and (a.constant == b.constant).all()
