import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cuelog.llm.secrets import RULES

from .test_decontaminate import _brute as leaks
from .test_quality import _brute as metrics
from .test_secrets import _brute as spans

SF = "/root/testdata/sf0.001"


def _redacted(text):
    out, at = [], 0
    for start, _, kind, end in spans(text, RULES):
        if start >= at:
            out.append(text[at:start] + f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_against_plain_stages(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def good(text):
        m = metrics(text)
        return m[0] >= 20 and 100 * m[5] <= 30 * m[0]

    kept = [d for d in docs if good(d[1])]
    first = _heads(kept, 5, 80)
    kept = [d for d in kept if d[0] in first]
    clean = {i for i, _, hit, *_ in leaks(kept, items, 10) if not hit}
    kept = [(i, _redacted(t)) for i, t in kept if i in clean]
    assert 20 < len(kept) < len(docs)
    tk, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in kept:
        ids = np.array([*tk.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text + " x", "en", "s", 1), (None, None, "en", "s", 1), (3, "", "en", "s", 0), (4, "token=abcdefghijklmnop " + text.replace("word", "other"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "4", "None"]
    assert [r.text for r in docs.collect() if r.doc_id == 4][0].startswith("[assign] other0")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert re.search("packing", corpus_pipeline.STAGES[-1][0])


def _heads(rows, words, percent):
    """The smallest id of every group that links of similar shingles make."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))) for i, t in rows]
    sets = {i: {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} for i, w in split if w}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = {i: i for i, _ in rows}
    for _ in sets:
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    return {i for i, head in group.items() if i == head}


def test_near_copies_at_the_limit_of_stages(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(8):
        words = [f"t{i}w{k}" for k in range(100)]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 5):
            copy = list(words)
            for at in rng.choice(np.arange(6, 94, 6), j, replace=False):
                copy[at] = f"new{j}"
            rows.append((10 * i + j, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    assert got == sorted(_heads(rows, 5, 80)) != sorted(_heads(rows, 4, 85))
