"""Every operator takes ids of another type, repeated ones, and rows without one."""

from pyspark.sql import functions as F

from kontor.llm import decontaminate, hmm, language, near_dedup, pieces, pii, substring_dedup, toxicity

A = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
B = A.replace("alpha3 ", "gamma3 ")
ROWS = [("x", A), ("x", A), ("y", B), ("y", "another text of the same id"), (None, A), ("z", None), ("w", "call 10.0.0.1 or a@b.example you idiot")]


def table(spark):
    return spark.createDataFrame([(i, t, "en", 1, True) for i, t in ROWS], "doc_id string, text string, lang string, slot int, hit boolean").repartition(2)


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(tuple(r[c] for c in columns))
    return out


def test_row_by_row_operators(spark):
    df = table(spark)
    labels = spark.createDataFrame([("w", 1), ("x", 0), (None, 0), ("w", 0)], "doc_id string, toxic int")
    found = pii.digest_columns(pii.find_personal_data(df))
    assert found.count() == len(ROWS) and by_id(found, "n_ip", "n_email")["w"] == {(1, 1)}
    scored = toxicity.toxicity(df, labels)
    assert scored.count() == len(ROWS) and len(by_id(scored, "score")["x"]) == 1
    assert language.language(df).count() == len(ROWS)
    modelled = hmm.language_model(df.select("doc_id", "text"))
    assert modelled.count() == len(ROWS) and by_id(modelled, "n_tokens")["x"] == {(121,)} and by_id(modelled, "n_tokens")["z"] == {(1,)}
    import public_tokenizers

    encoded = pieces.digest_columns(pieces.round_trip(df, public_tokenizers.path("piece_bpe_32k.model")))
    assert encoded.count() == len(ROWS) and len(by_id(encoded, "ids_sha256")["x"]) == 1


def test_operators_on_pairs(spark):
    df = table(spark)
    near = near_dedup.near_dedup(df)
    assert near.count() == len(ROWS)
    got = by_id(near, "n_shingles", "component_id", "kept")
    assert got["x"] == {(116, "x", True)} and got["z"] == {(0, "z", True)} and (116, "x", False) in got["y"]
    cut = by_id(substring_dedup.substring_dedup(df), "n_words", "n_removed")
    assert cut["x"] == {(120, 0)} and cut[None] == {(120, 0)} and cut["z"] == {(0, 0)}


def test_decontamination(spark):
    items = spark.createDataFrame([("i", A), ("j", A), (None, A), ("k", None)], "item string, text string")
    got = decontaminate.overlaps(table(spark).withColumnRenamed("doc_id", "id"), items).select("id", "item").collect()
    assert {tuple(r) for r in got} == {(d, i) for d in ("x", "y", None) for i in ("i", "j")} and len(got) == 6
    kept = decontaminate.clean(table(spark), items)
    assert kept.columns == table(spark).columns and {r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()} == {"z", "w"}


def test_a_larger_benchmark_takes_the_shuffle(spark):
    items = spark.createDataFrame([("i", A), ("j", B)], "item string, text string")
    docs = table(spark).withColumnRenamed("doc_id", "id")
    small, large = (sorted(map(str, decontaminate.overlaps(docs, items, held=held).collect())) for held in (1 << 18, 0))
    assert small == large and small
