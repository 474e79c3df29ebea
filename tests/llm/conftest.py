import pytest

#: Whole texts with nulls, empty and repeated ones, ties and a long one; every operator must take them.
TEXTS = [
    None,
    "",
    "   \n\t",
    "a",
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "the  quick\nbrown fox jumps over the lazy dog near the river bank today",
    "ä ö ü ñ 日本語 テスト 😀 ok",
    " ".join(f"w{i}" for i in range(30_000)),
    "no spaces" * 3000,
    "ha " * 500,
]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, lang, source, n_chars, kind, start, id): names that operators use inside clash on purpose."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 7) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kind string, start int, id int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < 0")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
