import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuelog.llm.packing import Bins, Capacity, cut_pieces, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, World's  end!!", "ÉTÉ à l'œuvre ²3 don't WE'LL", "日本語 and Σίσυφος ΣΑΣ", "á é", "x<|endoftext|>y", "tab\tnew\nline\x1c\x85\xa0z", "ﬁ İI ŉ", "\U0001F600 ok",
         "word " * 9000, "naïve-café_2024 (test) 'S 'sdf", "x" * 5000, "Straße ẞ ­"]


def test_pieces_match_the_tokenizer(spark):
    tk = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])], "doc_id long, text string").selectExpr("*", "1 piece")
    rows = cut_pieces(df, PATH, 512).collect()
    want = []
    for doc, text in [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])]:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, a, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_words_of_the_table_match_the_tokenizer(spark):
    tk = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in cut_pieces(docs, PATH).collect()}
    for r in docs.collect():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            assert got.pop((r.doc_id, k)) == (len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes()))
    assert not got


def _check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= (capacity.documents or 1 << 60) and sum(n * n for _, n in parts) <= (capacity.attention or 1 << 60)
    return len(held)


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(documents=3), Capacity(attention=9_000_000 + 4096 ** 2 // 2, score="dot"), Capacity(score="dot")])
def test_packing(spark, capacity):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in np.minimum(rng.lognormal(6.2, 1.2, 3000).astype(int) + 1, 4096)]
    df = spark.createDataFrame([(n,) for n in lengths], "length long").filter("length * length <= 17388608 + 8000000")
    rows = pack(df, capacity, 1000, 256).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    used = _check(rows, capacity)
    if capacity.documents is None and capacity.attention is None:
        assert used <= 1.03 * -(-sum(lengths) // 4096) + 3
    assert pack(df.limit(0), capacity).count() == 0


def test_best_fit_by_hand():
    bins = Bins(Capacity(tokens=10))
    names, offsets = bins.put(np.array([6, 7, 3, 4, 1]))
    assert list(names) == [1, 0, 0, 1, 2] and list(offsets) == [0, 0, 7, 6, 0]
    with pytest.raises(ValueError):
        bins.put(np.array([11]))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    used = _check(rows, Capacity())
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 2
