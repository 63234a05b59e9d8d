"""The registered queries over whole small tables, against DuckDB or plain Python."""

import hashlib

import duckdb

from cuelog.llm.queries import QUERIES, SQL

from .test_decontaminate import _brute as leaks
from .test_jaccard import brute as groups
from .test_secrets import _brute as spans
from .test_suffix_array import brute as repeats
from .test_suffix_trees import brute as passages

SF = "/root/testdata/sf0.001"


def _documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 1 + len(QUERIES))) and set(SQL) <= set(QUERIES)


def test_sql_twins(spark):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in SQL.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_secret_scans(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_secret_scans"](spark, SF).collect()}
    for doc, text in _documents(spark):
        found = spans(text)
        base = [s for s in found if s[2] in ("assign", "access", "hex")]
        spelled = lambda some: ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in some)
        count = lambda kind: sum(s[2] == kind for s in base)
        assert got[doc] == (count("assign"), count("access"), count("hex"), _sha(spelled(base).encode()), spelled(found))


def test_repeats(spark):
    docs = _documents(spark)
    got = sorted(map(tuple, QUERIES["op5_suffix_array_dedup"](spark, SF).collect()))
    assert got == sorted((i, *b[:3], _sha(b[3])) for (i, _), b in zip(docs, repeats([t for _, t in docs], 200), strict=True))
    got = sorted(map(tuple, QUERIES["op9_substring_dedup"](spark, SF).collect()))
    assert got == sorted((i, n, gone, _sha(kept)) for i, n, gone, kept in passages(docs, 13))
    assert sum(g[2] for g in got) > 0


def test_near_copies_and_leaks(spark):
    docs = _documents(spark)
    assert sorted(map(tuple, QUERIES["op8_ngram_jaccard_join"](spark, SF).collect())) == sorted(groups(docs, 85))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_benchmark_decontamination"](spark, SF).collect())) == sorted(leaks(docs, items, 10))
