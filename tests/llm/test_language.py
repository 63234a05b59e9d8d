import zlib

import zstandard

from cuelog.llm.language import Classifier, Settings, identify, letters, train
from cuelog.llm.queries import op2_language_id

EN = "the quick brown fox jumps over the lazy dog while seven wizards were boxing with another cat near the old stone bridge and the river"
DE = "der schnelle braune fuchs springt weit hinweg und die katze schläft neben dem alten hund auf der langen mauer und der garten"
SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.95 * len(tested)


def test_matches_plain_coding(spark):
    train_rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de")] * 5)]
    train_rows += [(90, None, "en"), (91, "x y z", None), (92, "123", "zz"), (None, "und der die das", "de")]
    content = train(spark.createDataFrame(train_rows, "doc_id long, text string, lang string"))
    assert set(content) == {"en", "de"} and content["en"].split()[-1] == b"the"
    texts = [None, "", "12 34 !!", "the lazy dog and another wizards bridge", "DIE KATZE und der langen Hund schläft", "é", "the quick bridge over another " * 2000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])], "doc_id long, text string").selectExpr("*", "1 score")
    got = identify(docs, content).collect()
    assert len(got) == 9
    for r in got:
        if r.doc_id is not None and r.doc_id < 3:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[6].lang_pred == "en" and by[4].lang_pred == by[None].lang_pred == "de"
    sizes = Classifier(content, Settings()).sizes(texts[6])
    whole = letters(texts[6])
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content["de"], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(
        6, dict_size=len(content["de"]), source_size=2000, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False))
    assert sizes[0] == sum(len(coder.compress(whole[i:i + 2000].encode())) for i in range(0, len(whole), 2000))
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    assert train(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}
    assert identify(docs.limit(0), content).count() == 0


def test_letters_and_repeated_rows(spark):
    """Fractions and Roman numerals are no letters; one row a million times is one row of the sample."""
    from cuelog.llm.language import Settings, identify, train
    rows = [(1, "the same row of words", "en")] * 3000 + [(None, f"other words number {'abcdefghij'[k]}", "en") for k in range(10)] + [(k, f"mots divers {'abcdefghij'[k]} et autres", "fr") for k in range(10)]
    learned = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Settings(sample_docs=20))
    assert b"other" in learned["en"] and b"same" in learned["en"] and b"divers" in learned["fr"]
    odd = spark.createDataFrame([(1, "½ ² Ⅷ 3"), (2, "½ words"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(odd, learned).collect()} == {1: "und", 2: "en", 3: "und"}
