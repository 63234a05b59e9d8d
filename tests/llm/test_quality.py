import re

from cuelog.llm.quality import METRICS, Limits, host_verdicts, keep_good, quality_rules, rule_metrics


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(cover))


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h a b c d e f g h", "x " * 30,
         "p q r s t u v w x\np q r s t u v w x\n\n \nend # $ é ü \U0001F600", "\x1fodd\x85word|<>", "l1 a\nl1 a\nl1 a\n" * 3,
         " ".join(f"w{i % 13}" for i in range(40)), " ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9"]


def test_metrics_match_a_plain_count(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'s' source", "1 n_lines")
    rows = {r.doc_id: r for r in rule_metrics(df).collect()}
    for i, text in enumerate(TEXTS):
        got = tuple(rows[i][c] for c in METRICS)
        assert got == _brute(text), (i, text and text[:60])
        assert rows[i].base_failed == (got[0] < 20 or 100 * got[5] > 30 * got[0])


def test_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(30)), " ".join(f"w{i}###" for i in range(30))
    rows = [(i, f"h{i % 5}", good) for i in range(50)] + [(i, "bad", bad) for i in range(50, 90)] + [(90, "bad", good), (91, None, good), (None, "h1", None), (91, None, good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    verdicts = {r.source: r for r in host_verdicts(rule_metrics(df)).collect()}
    assert {h for h, r in verdicts.items() if r.host_rejected} == {"bad"} and None not in verdicts
    assert 0 < verdicts["h0"].host_rate < 0.5 < verdicts["bad"].host_rate < verdicts["bad"].host_failures / verdicts["bad"].host_docs
    kept = [(r.doc_id, r.kept) for r in quality_rules(df).collect()]
    assert len(kept) == len(rows) and sum(k for _, k in kept) == 52
    assert keep_good(df).columns == df.columns and keep_good(df).count() == 52
    assert not any(r.host_rejected for r in host_verdicts(rule_metrics(df), limits=Limits(host_rate=1.0)).collect())
    assert quality_rules(df.limit(0)).count() == 0
