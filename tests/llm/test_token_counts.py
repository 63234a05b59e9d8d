"""Token counts of spliced chunks against the library's count of the whole text."""

import random

import public_tokenizers
import pytest
import sentencepiece

from cuelog.llm import token_counts
from cuelog.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
WHOLE = sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts():
    rng = random.Random(5)
    alphabets = ["ab", "aab ", "the and ing tion ", "0123456789 .", "日本語テキスト", "é́ \n\t", " ▁", "<s></s>", "👩‍👩‍👧a ", "\x00\x07 x", "".join(map(chr, range(32, 127)))]
    for letters in alphabets:
        for size in (1, 40, 700):
            yield "".join(rng.choice(letters) for _ in range(size))
    yield from ("a" * 3000, " " * 2000, "ab" * 1500, "\n" * 500, "straße " * 300, "x" + " y" * 900, "")


def test_splices_at_every_place():
    """Two overlapping chunks give the whole count, wherever they have a common token."""
    coder, spliced = token_counts.Coder(PATH), 0
    rng = random.Random(7)
    for text in _texts():
        for _ in range(20 if len(text) > 2 else 0):
            low = rng.randrange(1, len(text))
            high = rng.randrange(low, len(text)) + 1
            left, right = coder.starts(text[:high]), coder.starts(text[low:])
            met = token_counts.splice(token_counts._packed(left[0], left[1], low, high), token_counts._packed(right[0], right[1], 0, high - low))
            if met is not None:
                assert met[0] - met[1] + right[2] == len(WHOLE.encode(text)), (text, low, high)
                spliced += 1
    assert spliced > 250


def test_chunks(spark):
    rows = [(k, t, "x", 3) for k, t in enumerate(_texts())] + [(None, None, None, None), (3, "a b", "x", 1), (3, "a b", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, key int")
    for chunk, overlap in ((64, 8), (500, 1), (token_counts.CHUNK, token_counts.OVERLAP)):
        got = token_counts.token_counts(docs, PATH, limit=100, chunk=chunk, overlap=overlap)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        want = [(i, len((t or "").encode()), len(WHOLE.encode(t or ""))) for i, t, *_ in rows]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((*w, w[2] > 100) for w in want), key=str)


def test_empty_and_unfit_models(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(RuntimeError):
        token_counts.Coder(PATH + ".missing")


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = sorted((d.doc_id, len((d.text or "").encode()), len(WHOLE.encode(d.text or ""))) for d in docs)
    assert sorted(tuple(r)[:3] for r in QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.001").collect()) == want
