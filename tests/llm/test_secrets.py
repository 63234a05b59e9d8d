import re

from cuelog.llm.secrets import RULES, Rule, candidates, redact, scan_secrets, trigram_query


def _brute(text, rules=RULES):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", (re.IGNORECASE if rule.any_case else 0) | re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


TEXTS = [None, "", "password: hunter2hunter2 and Password = 'short' x", "PASSWD=\"abcdefghijkl\"; token: token: abcdefghijklmnop", "secret   =   0123456789abcdef0123",
         "AKIAABCDEFGHIJKLMN AKIASHORT AKIAAKIAABCDEFGHIJ", "api_key:aaaaaaaaaaaa apikey='bbbbbbbbbbbbb", "é\U0001F600 token=abcdefabcdefabcdef0 \U0001F600 deadbeefdeadbeef",
         "deadbeef" * 40, "-----BEGIN RSA PRIVATE KEY-----\nx", "eyJhbGciOi.eyJzdWIi.abc_-", "postgres://me:pw@host.example/db redis://a:b@c", "passworx: tokem secre apikez",
         "x" * 50000 + " token=abcdefghijklm", "password: password: password: abcdefghijklmnop", "token = abcdefghijklm\ntoken\t=abcdefghijklm", "deadbeefdeadbeef " * 300]


def test_queries():
    q = {r.kind: trigram_query(r) for r in RULES}
    assert q["hex"] == [] and frozenset({"AKI", "KIA"}) in next(iter(q["access"]))
    assert frozenset({"pas", "ass", "ssw", "swd"}) in q["assign"][0] and len(q["assign"][0]) == 6
    assert trigram_query(Rule("x", "ab+cde(fg|hi)?j[0-9]xyz")) == [frozenset({frozenset({"cde", "def", "efg", "fgj"}), frozenset({"cde", "deh", "ehi", "hij"}), frozenset({"cde", "dej"})}), frozenset({frozenset({"xyz"})})]


def test_spans_match_a_plain_scan(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[3]), (2, TEXTS[3]), (None, TEXTS[2]), (None, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' secrets", "1 kinds")
    got = [(r.doc_id, r.text, [(s.start, s.rank, s.kind, s.end) for s in r.secrets]) for r in scan_secrets(df).collect()]
    assert sorted(got, key=str) == sorted([(d, t, _brute(t)) for d, t in rows], key=str)
    assert scan_secrets(df.limit(0)).count() == 0
    offered = {r.doc_id: r.kinds for r in candidates(df).collect()}
    assert 12 not in offered and offered[9] == ["pem"] and 8 not in offered


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert redact(df).columns == df.columns
    assert got[0] is None and got[1] == "" and got[12] == TEXTS[12] and got[5] == "[access] AKIASHORT [access]"
    assert got[7] == "é\U0001F600 [assign] \U0001F600 [hex]"
    assert all(not _brute(t) for t in got.values())
