"""Goldens for texts, gates, glossary, batches and checkpoints."""

import difflib
import re
import time

from pyspark.sql import functions as F

from cuelog.functions import numbers as nb
from cuelog.functions import text as tx
from cuelog.functions.batching import build_marker_batch, parse_marker_batch
from cuelog.functions.udfs import _ratio
from cuelog.operators import pairs as pr
from cuelog.operators import segments as sg


def _one(spark, value, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(value.alias("v")).first().v


def test_asr_quality(spark):
    rows = [(1, 0, 0.0, 1.0, "Same, text", -1.2, 1.0, .1, 0.0, [1]), (1, 1, 1.0, 2.0, "same text", -.1, 2.9, .1, .6, [1]),
            (1, 2, 2.0, 3.0, "same  text!", -.1, float("nan"), .9, None, None)]
    df = spark.createDataFrame(rows, "media_id int, ord int, start double, end double, text string, avg_logprob double, "
                                     "compression_ratio double, no_speech_prob double, temperature double, words array<int>")
    r = sg.asr_quality(df).first()
    assert (r.segments, r.word_timed_segments, r.low_logprob_segments, r.high_compression_segments) == (3, 2, 1, 1)
    assert (r.high_no_speech_segments, r.temperature_fallback_segments, r.repeated_adjacent_segments) == (1, 1, 2)
    assert (r.longest_repeat_run, r.suspicious_ratio, r.warn) == (3, .6667, True)


def _gate(spark, source, translated, src="en", tgt="ru"):
    df = spark.createDataFrame([(source, translated, src, tgt)], "source string, translated string, source_lang string, target_lang string")
    return pr.quality_gate(df).first().reasons


def test_quality_gate(spark):
    url = "see https://example.com/a/v3 now 3.14"
    assert _gate(spark, url, "смотри https://example.com/a/v3 сейчас 3,14") == []
    assert "numeric_token_changed" in _gate(spark, "value 3.14 is here", "значение 3.15 здесь вот")
    assert "protected_token_changed" in _gate(spark, url, "смотри https://example.com/a/v4 сейчас 3,14")
    assert _gate(spark, "it costs 12,500 a year", "это стоит 12 500 в год") == []
    assert _gate(spark, "hello there", "  ") == ["empty"]
    assert "too_short" in _gate(spark, "x" * 100, "да")
    assert "mostly_unchanged" in _gate(spark, "the same sentence again", "the same sentence again")
    assert "source_language_left" in _gate(spark, "please open several windows", "please open several окна")
    assert "source_words_left" in _gate(spark, "simple remaining words", "это простые слова и remaining simple")
    assert "source_word_left" in _gate(spark, "some consideration here", "это такое интересное consideration")
    assert "source_script_left" in _gate(spark, "你好吗朋友", "привет друзья 你好", "zh")
    assert _gate(spark, "Docker runs Python", "Docker запускает Python хорошо") == []


def test_gate_similarity_prefilter(spark):
    pairs = [("abcdefghij klmno", "abcdefghij klmnq"), ("abcdefghij klmno", "zzzz"), ("one two three four", "one two three five"),
             ("longer text that is quite alike", "longer text that is quite alike!!")]
    for a, b in pairs:
        norm = [" ".join(re.findall(r"\w+", x.lower())) for x in (a, b)]
        want = difflib.SequenceMatcher(None, *norm).ratio() >= .88 and len(norm[0]) >= 8
        assert ("mostly_unchanged" in _gate(spark, a, b, "en", "de")) == want, (a, b)


def test_rows_that_compare_nothing_are_dealt(spark):
    """With a shuffled join they are dealt over the tasks, not sent to one as nulls."""
    df = spark.range(2000).selectExpr("id", "concat('one text ', id) source", "'a quite different and much longer translation of it' translated", "'en' source_lang", "'de' target_lang")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, value in zip(keep, ("-1", "false", "4")):
            spark.conf.set(k, value)
        rows = pr.quality_gate(df).select("id", "reasons", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, value in keep.items():
            spark.conf.set(k, value)
    assert len({r.id for r in rows}) == len(rows) == 2000
    assert max(sum(r.p == p for r in rows) for p in range(4)) < 1000


def test_ratio_of_texts_that_begin_alike():
    for a, b in [("ab", "ab"), ("ab", "ab c"), ("ab ba " * 60, "ab ba " * 70 + "zz"), ("abab" * 80 + " q", "abab" * 80), ("abc", "abd")]:
        assert _ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_validate_response(spark):
    rows = [("Error 500 Server error. There was an error. Please try again later.", "hi", "provider_error_page_500"),
            ("<html><body>502 Bad Gateway</body></html>", "hi", "provider_html_error_page"),
            ("<b>bold</b> <title>x</title>", "hi", "ok"),
            ("There was an error. Please try again later. Server error", "what about error 500", "ok"),
            ("503 Service Unavailable", "hi", "provider_http_503"), ("please solve the CAPTCHA", "hi", "provider_block_or_captcha_page"),
            ("  ", "hi", "empty_response"), ("обычный перевод", "hi", "ok")]
    df = spark.createDataFrame([r[:2] for r in rows], "translated string, source string")
    got = {(r.translated, r.source): (r.reason, r.valid) for r in pr.validate_response(df).collect()}
    for text, source, reason in rows:
        assert got[(text, source)] == (reason, reason == "ok")


def test_glossary(spark):
    terms = [("CUDA", "КУДА", 0), ("RAM", "ОЗУ", 1), ("RAM disk", "диск $1", 2), ("C++", "Си\\плюс", 3), ("_x", "икс", 4)]
    gloss = spark.createDataFrame(terms, "source_term string, target_term string, ord bigint")
    pairs = spark.createDataFrame([(1, 1, "CUDA and RAM", "cuda и RAM, RAMP"), (1, 2, "nothing", "CUDA"),
                                   (1, 3, "a RAM disk in C++", "RAM disk C++ C++x"), (1, 4, "call a_x", "a_x")],
                                  "media_id int, seg_index int, source string, translated string")
    want = {1: ("КУДА и ОЗУ, RAMP", 2), 2: ("CUDA", 0), 3: ("диск $1 Си\\плюс Си\\плюсx", 3), 4: ("aикс", 1)}
    for some in (gloss, gloss.unionByName(gloss.selectExpr("concat('zz', source_term) source_term", "target_term", "ord"))):
        out = pr.apply_glossary(pairs, some)
        assert {r.seg_index: (r.translated, r.replacements) for r in out.collect()} == want


def test_marker_batches(spark):
    items = "array(named_struct('index', 1L, 'text', ' one '), named_struct('index', 2L, 'text', 'two'))"
    df = spark.range(1).select(F.expr(items).alias("items")).withColumn("sent", build_marker_batch(F.col("items")))
    def parsed(reply):
        return df.select(parse_marker_batch(reply, F.col("items")).alias("p")).first().p
    sent = F.col("sent")
    assert parsed(sent).texts == {1: "one", 2: "two"}
    assert parsed(F.regexp_replace(sent, "__SEG_[0-9A-F]+_0002_END__", "")).error == "marker_missing_or_repeated"
    assert parsed(F.concat(sent, F.lit(" extra"))).error == "text_after_last_marker"
    assert parsed(F.replace(sent, F.lit("two"), F.lit(" "))).error == "empty_text"
    assert not parsed(F.concat(sent, sent)).ok


def test_split_text(spark):
    texts = ["", "short", "word " * 1500, "x" * 9000, ("a" * 1000 + " ") * 9, " " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.split_text("t").alias("p")).collect():
        parts, text, offset = [], texts[r.i], 0
        while len(text) - offset > 3900:
            ends = [m.end() for m in re.finditer(r"\s+", text[offset:offset + 3900]) if m.end() >= 1950]
            end = offset + (ends[-1] if ends else 3900)
            parts.append(text[offset:end])
            offset = end
        if offset < len(text):
            parts.append(text[offset:])
        assert r.p == parts


def test_scalars(spark):
    assert _one(spark, tx.normalize_tts_text("t"), t="  Hi —  you ,  ok!!!! ") == "Hi,  you, ok!"
    assert [_one(spark, nb.edge_rate("s"), s=x) for x in (1.0, 1.04, 1.045, 1.075, 1.5)] == [0, 0, 4, 7, 14]
    assert _one(spark, nb.srt_timestamp("s"), s=3661.0005) == "01:01:01,000"
    assert _one(spark, nb.fmt_time("s"), s=6001.0) == "100:01"
    assert _one(spark, tx.signature_text("t"), t="See HTTPS://x/y?z 42 deadbeefdeadbeef00") == "see <url> <n> <hash>"
    assert _one(spark, tx.redact("t"), t="url: http://a/b?c=d api_key=zzz") == "url: http://a/b?... api_key=<скрыто>"
    assert len(_one(spark, tx.redact("t", 100), t="ab " * 200)) <= 100
    assert [_one(spark, nb.retry_delay("n"), n=n) for n in (1, 2, 3, 4, 5, 5000)] == [1.5, 3.0, 6.0, 12.0, 20.0, 20.0]


def test_vocabulary_prompt(spark):
    import random
    rng = random.Random(3)
    words = ["".join(rng.choice("abCD") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    words = list(dict.fromkeys(words))
    gloss = spark.createDataFrame([(w, "x", i) for i, w in enumerate(words)], "source_term string, target_term string, ord bigint")
    for budget, limit in ((60, 64), (900, 64), (200, 5)):
        picked, used, seen = [], 0, set()
        for term in sorted(words, key=lambda v: (-len(v), v.casefold())):
            cost = len(term) + (2 if picked else 0)
            if term.casefold() in seen or used + cost > budget:
                continue
            picked.append(term)
            seen.add(term.casefold())
            used += cost
            if len(picked) >= limit:
                break
        got = pr.vocabulary_prompt(gloss, budget, limit).first().prompt
        assert got.lower() == ", ".join(picked).lower()


def test_backends(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, " "), (4, "cc")], "id int, text string").coalesce(1)
    def broken(texts, s, t):
        raise ValueError
    def picky(texts, s, t):
        return [x.upper() if len(x) > 1 else "" for x in texts]
    out = {r.id: r for r in pr.apply_backends(df, [("broken", broken), ("picky", picky)], "text", "en", "ru").collect()}
    assert out[2].translated == "BB" and out[2].backend == "picky" and out[3].backend == "none"
    assert out[1].error.startswith("backends failed: broken:ValueError")
    same = pr.apply_backends(df, [("broken", broken)], "text", "ru-RU", "ru").collect()
    assert {r.backend for r in same} == {"identity"}


def test_language_default(spark):
    languages = spark.createDataFrame([("German", "de"), ("Russian", "ru")], "label string, code string")
    asked = spark.createDataFrame([(1, "German"), (2, "Klingon")], "id int, label string")
    assert {r.id: r.code for r in pr.default_language(languages, asked, "Russian").collect()} == {1: "de", 2: "ru"}


def _shared(spark, rows, allowed=("http",)):
    df = spark.createDataFrame(rows, "id int, s array<string>, t array<string>")
    out = df.select("id", tx.shared_words(F.col("s"), F.col("t"), list(allowed)).alias("w"))
    return {r.id: r.w for r in out.collect()}


def test_shared_words_golden(spark):
    rows = [(1, ["Data", "http", "cat", "ÉCOLE"], ["data", "DATA", "http", "cat", "other", "école", "Data"]), (2, ["data"], []), (3, [], ["data"]),
            (4, None, ["data"]), (5, ["data"], None), (6, ["data", None], [None, "data"]), (7, ["other"], ["data"])]
    assert _shared(spark, rows) == {1: ["data", "DATA", "école", "Data"], 2: [], 3: [], 4: [], 5: None, 6: ["data"], 7: []}
    many = [(i, [f"word{i}", "same"], [f"word{i + 1}", "same", f"word{i}", "same"]) for i in range(700)]  # more rows than are looked up at once
    assert _shared(spark, many) == {i: ["same", f"word{i}", "same"] for i in range(700)}


def test_shared_words_of_long_texts(spark):
    """Looking every word up in the list of the others would take minutes."""
    words = [f"word{i}" for i in range(100000)]
    begin = time.monotonic()
    assert _shared(spark, [(1, words, words[::-1])])[1] == words[::-1]
    assert time.monotonic() - begin < 25
