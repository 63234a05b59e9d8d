import re

import numpy as np
import pytest

from cuelog.llm.components import components
from cuelog.llm.jaccard import jaccard_components


def brute(rows, percent):
    def grams(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        return {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()

    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    sets = [grams(t) for _, t in rows]
    up = {o: o for o in order}

    def root(o):
        while up[o] != o:
            o = up[o]
        return o

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(order[a]), root(order[b])
                up[max(x, y)] = min(x, y)
    real = lambda o: None if o == (1 << 63) - 1 else o
    return [(i, len(s), real(root(o))) for (i, _), s, o in zip(rows, sets, order, strict=True)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 230)] + [(500, k) for k in range(300, 340)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("percent", [85, 60])
def test_matches_all_pairs(spark, percent):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ab"]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, None), (6, None), (7, "x " * 80), (8, "x " * 300)]
    for i in range(10, 40):
        words = list(rng.choice(vocabulary, int(rng.integers(4, 60))))
        rows.append((i, " ".join(words)))
        for k in range(int(rng.integers(0, 7))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"m{rng.integers(0, 5)}"
            rows.append((int(rng.integers(100, 100_000)) if k else (None if i % 10 == 0 else 50 + i), " ".join(copy).upper() if k == 2 else " ".join(copy)))
    rows += [(60_000 + k, rows[12][1]) for k in range(20)] + [(9, rows[13][1]), (9, rows[13][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' n", "1 key")
    got = [tuple(r) for r in jaccard_components(df, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, percent), key=str)
    assert len({c for _, _, c in got}) < len(rows) - 30


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
