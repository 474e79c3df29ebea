import hashlib
import re

from kontor.llm.exact_dedup import exact_dedup, keep_first
from kontor.llm.shared import without


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare])[2]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


ROWS = [(5, "a b"), (3, "ab"), (4, "a b"), (9, None), (8, ""), (7, " \n"), (1, "é 😀"), (2, "é😀 "), (2, "é😀 "), (2, "other"), (None, "ab  "), (None, "alone")]


def test_against_groups_in_memory(spark):
    rows = ROWS + [(100 + i, "hot " + " " * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(exact_dedup(df)) == brute(rows)
    assert result(exact_dedup(df, tracked=4, winners=1)) == brute(rows)  # few counters: most groups take the ordinary shuffle


def test_ids_of_another_type(spark):
    rows = [(None if i is None else f"d{i}", t) for i, t in ROWS]
    assert result(exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"))) == brute(rows)


def test_rows_of_one_id_go_by_their_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    gone = {(i, t) for i, t in ROWS if not next(k for j, _, _, k, s in brute(ROWS) if j == i and s == hashlib.sha256(re.sub(r"\s", "", t or "").encode()).hexdigest())}
    got = [tuple(r) for r in keep_first(df).collect()]
    # rows without an id cannot be named, so they stay
    assert sorted(got, key=str) == sorted((r for r in ROWS if r not in gone or r[0] is None), key=str)
    assert (2, "other") in got and (2, "é😀 ") not in got


def test_odd_rows(odd, none):
    assert result(exact_dedup(odd)) == brute(odd.select("doc_id", "text").collect())
    assert exact_dedup(none).count() == 0 and keep_first(none).columns == none.columns


def test_columns_stay(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else str(i), i, i, True, "k") for i in range(9)], "doc_id long, text string, slot long, word long, hit boolean, held string")
    kept = keep_first(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.where("doc_id not in (1, 2)").collect())
    ids = spark.createDataFrame([(5,), (100,)], "doc_id long")
    assert sorted(r.doc_id for r in without(df, "doc_id", ids).collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
