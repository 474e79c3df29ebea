import hashlib
import random

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece

from kontor.llm import queries
from kontor.llm.flat import chunks
from kontor.llm.pieces import Encoder, Vocabulary, decode, digest_columns, round_trip

from .conftest import SF, TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_against_the_library(library):
    rng = random.Random(3)
    texts = ["", " ", "a", "aaaaaaaa", " " * 40, " " * 100, " " * 57 + "word", "x" + " " * 333 + "y", None, *TEXTS]
    for alphabet in ("ab ", "aeiou  \n", "the quick ▁ 日本é😀\t", "\x00　 x▁", "   a", "aa", "1234567890 ,.-"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    vocabulary = Vocabulary(PATH)
    encoder = Encoder(vocabulary)
    for chunk in chunks(pa.record_batch([pa.array(texts)], names=["text"]), limit=5000):
        ids, offsets = encoder.encode(chunk)
        data, bounds = decode(vocabulary, ids, offsets)
        for i, text in enumerate(texts[chunk.rows]):
            want = library.encode(text or "", add_eos=True)
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text
            assert data[bounds[i] : bounds[i + 1]].tobytes().decode() == library.decode(want)


def test_query_against_the_library(spark, docs, library):
    got = {r.doc_id: r for r in queries.op4_pieces(spark, SF).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, none):
    rows = {r.doc_id: r for r in round_trip(odd, PATH).collect()}
    assert rows[0].ids == [2] and rows[0].decoded == "" and rows[4].ids == rows[5].ids
    assert rows[7].decoded == TEXTS[7]
    assert digest_columns(round_trip(none, PATH)).count() == 0
