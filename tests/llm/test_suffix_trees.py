import re

import numpy as np
import pytest

from cuelog.llm.suffix_trees import deep_nodes, remove_repeats


def test_deep_nodes():
    words = np.array([[1, 2], [3, 4], [1, 2], [1, 3], [3, 4], [3, 4], [9, 9]], np.uint32)
    node = deep_nodes(words)
    assert node[0] == node[2] != -1 and node[1] == node[4] == node[5] != node[0] and node[3] == node[6] == -1
    assert len(deep_nodes(words[:0])) == 0


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [1 << 63 if i is None else i for i, _ in rows]
    first = {}
    for o, w in zip(order, words, strict=True):
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            first[key] = min(o, first.get(key, o))
    out = []
    for (i, _), o, w in zip(rows, order, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < o:
                gone[k:k + length] = True
        out.append((i, len(w), int(gone.sum()), " ".join(np.array(w, object)[~gone]).encode()))
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_matches_a_plain_search(spark, group, monkeypatch):
    import cuelog.llm.suffix_trees as module
    if group == 3:
        plain = module.full_prefixes
        monkeypatch.setattr(module, "full_prefixes", lambda spans, length, most: plain(spans, length, most, 1))
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(40)]
    text = lambda k: " ".join(rng.choice(vocabulary, k))
    shared = [text(14) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a " * 60), (3, "a " * 60 + "b"), (4, "x\ty\n")]
    for i in range(5, 90):
        parts = [text(int(rng.integers(0, 14))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, " ".join(shared[int(rng.integers(0, 4))].split()[int(rng.integers(0, 5)):]))
        rows.append((None if i % 11 == 0 else i, "  ".join(parts)))
        if rng.random() < 0.2:
            rows.append((i if rng.random() < 0.5 else i + 200, rows[-1][1]))
        if rng.random() < 0.2:
            rows.append((i + 100, rows[-1][1].replace("w1", "w2")))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_words", "'x' key")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeats(df, 6, 3, group).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 6), key=str)
    assert sum(g[2] for g in got) > 300


def test_same_run_twice_in_one_document(spark):
    words = lambda mark, k=20: " ".join(f"{mark}{i}" for i in range(k))
    passage, tail = words("p", 13), words("e", 13)
    again = f"{words('a')} {passage} {words('b')}"
    rows = [(3, f"{words('x')} {passage} {words('y')}"), (5, f"{words('s')} {again} {again}"), (6, f"{words('t')} {tail} {words('u')}"), (7, f"{words('v')} {tail} {words('w')}"),
            (7, f"q {words('v')} {tail} {words('w')}"), (None, f"{again} {again} {words('v')} {tail}")]
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 13), key=str)
    assert [g[2] for g in got if g[0] == 5] == [26]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
