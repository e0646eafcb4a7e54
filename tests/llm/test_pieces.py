"""SentencePiece encoding against the library itself, and its edge cases."""

import hashlib
import random

import pytest

from seqlake.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    model = pieces.default_model()
    return pieces.piece_table(model), sentencepiece.SentencePieceProcessor(model_file=model)


def test_equal_to_the_library_on_random_texts(both):
    ours, theirs = both
    rng = random.Random(3)
    some = list(ours.ids) + list("  \n\t▁éß😀\x00<>s/.,!?'\"09") + ["<s>", "<0x41>", "  ", "the ", " ", "　"]
    for _ in range(8000):
        text = "".join(rng.choice(some) if rng.random() < 0.5 else rng.choice("abcdefghinorst e.,1(") for _ in range(rng.randint(0, 14)))
        ids = theirs.encode(text)
        assert ours.encode(text) == ids
        assert ours.coded(text)[2] == ours.decode(ids) == theirs.decode(ids)


def test_documents_and_edges(spark, small, both):
    theirs = both[1]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [*[tuple(r) for r in docs.collect()], (-1, None), (-2, ""), (-2, ""), (None, "x " * 30000), (-3, "a" * 20000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_tokens int, ids_sha256 string")
    out = pieces.encode_texts(df)
    assert sorted(out.columns) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "n_tokens", "text"]
    for r in out.collect():
        ids = theirs.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    assert pieces.encode_texts(df.limit(0)).count() == 0
