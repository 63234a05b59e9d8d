from collections import Counter

import numpy as np
import pytest

from cuelog.llm.suffix_array import common_prefixes, remove_repeats, two_stage_order


def test_order_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 70))).astype(np.uint8)
        raw, depth = data.tobytes(), int(rng.choice([8, 16, 24]))
        order = two_stage_order(data, depth)
        assert sorted(order.tolist()) == list(range(len(data)))
        keys = [raw[i:i + depth].ljust(depth, b"\0") for i in order]
        assert keys == sorted(keys)
        got = common_prefixes(data, order, depth)
        for k in range(1, len(order)):
            same = next((j for j in range(depth) if keys[k][j] != keys[k - 1][j]), depth)
            assert got[k] == same // 8 * 8


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def corpus(rng, n):
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 6)))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words, k))
    shared = [text(12) for _ in range(5)]
    out = [None, "", "a" * 300, "ab" * 100, "é" * 40, "\0" * 90]
    for _ in range(n):
        parts = [text(int(rng.integers(0, 25))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, shared[int(rng.integers(0, 5))][int(rng.integers(0, 20)):])
        out.append(" ".join(parts))
        if rng.random() < 0.15:
            out.append(out[-1])
        if rng.random() < 0.15:
            out.append(out[-1][:30] + "#" + out[-1][31:])
    return out


@pytest.mark.parametrize("group", [512, 2, 1])
def test_matches_a_plain_search(spark, group):
    rng = np.random.default_rng(11)
    texts = corpus(rng, 90)
    ids = [i if i % 7 else None for i in range(len(texts))]
    ids[20] = ids[21]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 n_bytes", "'x' key", "2 marks")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, 40, 12, group).collect()]
    want = [(i, *b) for i, b in zip(ids, brute(texts, 40), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 1000


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
