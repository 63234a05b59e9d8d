import hashlib
import re

from cuelog.llm.decontaminate import decontaminate


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _brute(docs, items, width):
    out = []
    windows = [(str(i), w[k:k + width]) for i, t in items for w in [_words(t)] for k in range(max(1, len(w) - width + 1)) if w]
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for item, window in windows:
            for k in range(len(words) - len(window) + 1):
                if words[k:k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def test_matches_a_plain_scan(spark):
    items = [(1, "Alpha beta, gamma! Delta"), (2, "être ou ne pas"), (10, "x"), (3, None), (4, "--"), (2, "être ou ne pas"), (5, "a b a b a")]
    docs = [(0, "say ALPHA beta gamma; delta. x"), (1, "être, ou ne pas être x2"), (2, None), (3, ""), (4, "a b a b a b a " * 3),
            (4, "a b a b a b a " * 3), (None, "beta gamma delta alpha beta"), (7, "alphabeta gamma delta"), (8, "Être ou ne pas x x"), (9, "word " * 5000 + "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", __import__("pyspark").sql.functions.lit(1)).drop("n_words")
    i = spark.createDataFrame(items, "item_id long, text string")
    for width in (3, 10):
        got = [tuple(r) for r in decontaminate(d, i, width).drop("text", "hit_spans").collect()]
        assert sorted(got, key=str) == sorted(_brute(docs, items, width), key=str)
    spans = {r.doc_id: [(s.start, s.end) for s in r.hit_spans] for r in decontaminate(d, i, 3).collect()}
    assert [docs[0][1][a:b] for a, b in spans[0]] == ["ALPHA beta gamma; delta. x"]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, i).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate(one, i).first().n_hit == 0
