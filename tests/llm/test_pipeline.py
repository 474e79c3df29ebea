import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from kontor.llm import exact_dedup, near_dedup, queries
from kontor.llm.shared import sieve, without

from .conftest import SF


def test_stages_take_effect(spark, docs):
    """Each stage on its predecessor's rows keeps what its operator keeps, with the columns of documents."""
    columns, now, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == columns, name
        rows = {tuple(r) for r in now.collect()}
        kept = {tuple(r) for r in after.collect()}
        assert kept <= rows
        seen.append(len(kept))
        now = spark.createDataFrame(sorted(kept), docs.schema)
    assert len(docs.collect()) > seen[0] > seen[-1] > 0
    assert exact_dedup.exact_dedup(now).where("not kept").isEmpty() and near_dedup.near_dedup(now).where("not kept").isEmpty()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in now.collect()}
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.ids == library.encode(texts[r.doc_id], add_eos=True) for r in got)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()][:10] == [f"op{i}" for i in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("wanted", [[], [3, 10**12], [None, 1]])
def test_sieve_and_without(spark, wanted):
    df = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 3, 10**12)] + [(None, "n")], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in wanted], "key long")
    want = {i for i in wanted if i is not None}
    assert want & {1, 3, 10**12} <= {r.id for r in sieve(df, "id", ids).collect()}
    left = without(df, "id", ids)
    assert sorted(str(r.id) for r in left.collect()) == sorted(str(i) for i in (1, 2, 3, 3, 10**12, None) if i not in want)


def test_odd_rows_pass_through(spark, odd):
    now = odd
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
        now = stage(spark, now, SF)
        assert now.columns == odd.columns
    assert {3, 4, 7, 8} <= {r.doc_id for r in now.collect()}


def test_run_takes_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated ones and clashing columns through all stages."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (99, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert got == {i: library.encode(texts[i], add_eos=True) for i in (2, 3, 4, 7, 8, 9, 10)}
