"""Goldens for jobs, inventories, media checks and problem logs."""

import random

import pytest
from pyspark.sql import functions as F

from cuelog.functions.numbers import round_exact
from cuelog.operators import events as ev
from cuelog.operators import inventory as iv
from cuelog.operators import jobs as jb
from cuelog.operators import media as md
from cuelog.operators import timeline as tl
from cuelog.sources import writers as wr


def _log(spark, rows):
    return spark.createDataFrame(rows, "session_id string, sequence bigint, level string, event string, message string, "
                                       "stage string, exc_type string, exc_message string").withColumn(
        "ts", F.timestamp_seconds(F.col("sequence") + 1700000000))


def test_repeats_and_cards(spark):
    rows = [("s", i, "warning", "translation_retry", f"Attempt {i} of 9 at https://h/{i}?k={i}", "translation", "ReadTimeout",
             f"connect {i} timed out") for i in range(1, 101)]
    events = ev.diagnose(_log(spark, rows))
    stored = sorted(r.occurrence for r in ev.sample_repeats(events).filter("stored").collect())
    assert stored == [1, 2, 3, 5, 10, 20, 50, 100]
    quality = ev.diagnostics_quality(events).first()
    assert (quality.repeat_events_compacted, quality.unique_problem_signatures_total) == (92, 1)
    card = ev.rank_issue_cards(ev.issue_cards(ev.signature_rollup(events))).first()
    assert (card.occurrences_total, card.stored_samples, card.family, card.playbook) == (100, 8, "network_timeout", "network_retry")
    assert card.priority == "medium" and card.stage == "translation"


@pytest.mark.parametrize("block", [1, 7, 50000])
def test_problems_that_come_back(spark, monkeypatch, block):
    """Against a plain list of the problems seen last, with blocks of several sizes."""
    monkeypatch.setattr(ev, "BLOCK_ROWS", block)
    draw = random.Random(block)
    rows, want = [], {}
    for session in "abc":
        recent, times, want[session] = [], {}, 0
        for i in range(120):
            kind = draw.choice("pqrstuvw"[:3 + ord(session) % 97 * 3 + i % 3])
            level = draw.choice(["warning", "error", "info"])
            rows.append((session, i, level, f"event_{kind}", "m", None, None, None))
            if level == "info":
                continue
            name = (kind, level)
            want[session] += name not in recent and times.get(name, 0) > 0
            times[name] = times.get(name, 0) + 1
            recent = ([x for x in recent if x != name] + [name])[-4:]
    rows.append(("quiet", 0, "info", "event_p", "m", None, None, None))
    got = {r.session_id: r for r in ev.diagnostics_quality(ev.diagnose(_log(spark, rows)), recent=4).collect()}
    assert {s: r.problem_signatures_outside_recent_window for s, r in got.items()} == want | {"quiet": 0} and sum(want.values()) > 50
    assert got["c"].unique_problem_signatures_total == len({(r[2], r[3]) for r in rows if r[0] == "c" and r[2] != "info"})
    assert ev.diagnostics_quality(ev.diagnose(_log(spark, []))).count() == 0


def test_stored_of_equals_flags(spark):
    df = spark.range(1, 1300).select(F.lit("tts_retry").alias("event"), F.col("id").alias("occurrence"))
    flags = [r[0] for r in df.orderBy("occurrence").select(ev.stored_occurrence()).collect()]
    counts = [r[0] for r in df.orderBy("occurrence").select(ev.stored_of("occurrence")).collect()]
    assert counts == [sum(flags[:i + 1]) for i in range(len(flags))]


def test_session_report(spark):
    rows = [("s", 1, "error", "network_request_timeout", "a | b", None, None, None), ("s", 2, "info", "stage_started", "", "asr", None, None)]
    events = ev.diagnose(_log(spark, rows))
    verdict = ev.session_verdict(ev.session_counters(events), ev.diagnostics_quality(events))
    cards = ev.rank_issue_cards(ev.issue_cards(ev.signature_rollup(events)))
    text = wr.to_session_report(verdict, cards, ev.top_events(events)).first().document
    assert "Result: errors_detected" in text and "a \\| b" in text and "`stage_started` — 1" in text


def test_eviction_order(spark):
    day, key = 86400, lambda c: c * 64
    rows = [("r", key("a"), ".mp3", 400, 100, "edge"), ("r", key("a"), ".json", 100, 100, "edge"),
            ("r", key("b"), ".wav", 2400, 200, "prepared_wav_1"), ("r", key("b"), ".json", 100, 200, "prepared_wav_1")]
    df = spark.createDataFrame(rows, "root string, key string, suffix string, size bigint, mtime bigint, provider string")
    plan = {r.key: r.reason for r in iv.cache_eviction_plan(df, F.lit(300), max_bytes=2500, target_bytes=1000).collect()}
    assert plan == {key("a"): "", key("b"): "size_limited"}
    aged = {r.key: r.reason for r in iv.cache_eviction_plan(df, F.lit(200 + day)).collect()}
    assert aged == {key("a"): "", key("b"): "prepared"}
    active = spark.createDataFrame([("r", key("b"))], "root string, key string")
    kept = {r.key: r.reason for r in iv.cache_eviction_plan(df, F.lit(200 + 9 * day), active=active).collect()}
    assert kept == {key("a"): "stale", key("b"): ""}


def test_eviction_against_loop(spark):
    rng = random.Random(2)
    rows = [(i % 2, f"{i:03d}", rng.randint(1, 50), rng.randint(0, 5) * 86400, rng.random() < .4) for i in range(120)]
    entries = [(r, k, s, n, m, "prepared_wav_1" if p else "edge") for r, k, n, m, p in rows for s, n in ((".mp3", n), (".json", 1))]
    df = spark.createDataFrame(entries, "root int, key string, suffix string, size bigint, mtime bigint, provider string")
    plan = iv.cache_eviction_plan(df, F.lit(6 * 86400), retention_days=99, prepared_hours=9999, max_bytes=900, target_bytes=500)
    got = {r.key for r in plan.filter("delete").collect()}
    want = set()
    for root in (0, 1):
        mine = [x for x in rows if x[0] == root]
        left = sum(x[2] + 1 for x in mine)
        if left > 900:
            for _, k, n, m, p in sorted(mine, key=lambda x: (not x[4], x[3], x[1])):
                if left <= 500:
                    break
                want.add(k)
                left -= n + 1
    assert got == want


def test_unique_names_against_loop(spark):
    rng = random.Random(4)
    taken = {"a_TR.mp4", "a_TR_3.mp4", "a_TR_4.mp4", "b_TR_2.mp4", "a_TR_1.mp4", "a_TR_x.mp4", "c_TR_2.mp4"}
    asked = [(i, rng.choice("abc")) for i in range(40)]
    have, want = set(taken), {}
    for i, base in asked:
        name, n = f"{base}_TR.mp4", 2
        while name in have:
            name, n = f"{base}_TR_{n}.mp4", n + 1
        have.add(name)
        want[i] = name
    requests = spark.createDataFrame([("f", b, i) for i, b in asked], "folder string, base string, ord int")
    existing = spark.createDataFrame([("f", t) for t in taken], "folder string, name string")
    assert {r.ord: r.output_name for r in jb.assign_unique_names(requests, existing).collect()} == want


def test_repair_ids(spark):
    rows = [("t", 0), ("t", 1), ("t__recovered_2", 2), ("t", 3), ("u", 4)]
    df = spark.createDataFrame([(i, o, "queued") for i, o in rows], "task_id string, ord int, status string")
    got = {r.ord: (r.task_id, r.status) for r in jb.repair_task_ids(df).collect()}
    assert got[0] == ("t", "queued") and got[4] == ("u", "queued")
    assert got[1] == ("t__recovered_3", "failed") and got[3] == ("t__recovered_4", "failed")
    assert len({i for i, _ in got.values()}) == 5


def test_queue(spark):
    tasks = spark.createDataFrame([("a", 0, "running", "completed", "50"), ("b", 1, "running", "cancellation_requested", "bad"),
                                   ("c", 2, "running", "running", "7"), ("d", 3, "odd", "queued", "170"), ("e", 4, "queued", "queued", "-3")],
                                  "task_id string, ord int, status string, batch_status string, progress string")
    files = spark.createDataFrame([("a", "succeeded", "o1"), ("b", "succeeded", "o1"), ("c", "succeeded", "gone")],
                                  "task_id string, status string, output_path string")
    outputs = spark.createDataFrame([("o1",)], "output_path string")
    norm = jb.normalize_tasks(tasks)
    got = {r.task_id: (r.status, r.batch_status, r.progress) for r in jb.recover_tasks(norm, files, outputs).collect()}
    assert got == {"a": ("completed", "completed", 100), "b": ("cancelled", "cancelled", 0), "c": ("interrupted", "interrupted", 7),
                   "d": ("interrupted", "queued", 100), "e": ("queued", "queued", 0)}
    assert jb.next_task(jb.recover_tasks(norm, files, outputs)).first().task_id == "c"


def test_media_checks(spark):
    files = spark.createDataFrame([(1, 5000), (2, 5000), (3, 500), (4, 5000), (5, 5000)], "media_id int, size bigint")
    s = [(1, "video", 0, True, False, 0.0, 10.1, 25.0), (1, "audio", 1, True, False, 0.0, 10.0, None),
         (2, "video", 0, True, False, 0.0, 10.3, 2.0), (2, "audio", 1, True, False, .5, 10.0, None),
         (4, "video", 0, False, True, 0.0, 10.0, 25.0), (4, "audio", 1, False, False, 0.0, 10.0, None),
         (5, "video", 0, False, False, 0.0, 99.0, 25.0), (5, "video", 1, True, False, 0.0, float("nan"), 25.0), (5, "audio", 2, True, False, 0.0, 10.0, None)]
    streams = spark.createDataFrame(s, "media_id int, kind string, index int, is_default boolean, attached_pic boolean, "
                                       "start_time double, duration double, fps double")
    expected = spark.createDataFrame([(i, None, None, 10.0) for i in range(1, 6)],
                                     "media_id int, video_expected double, audio_expected double, shared_expected double")
    got = {r.media_id: r.reason for r in md.validate_media(files, streams, expected).collect()}
    assert got == {1: "ok", 2: "audio_unexpected_start_time", 3: "output_missing_or_too_small",
                   4: "missing_video_or_audio_stream", 5: "video_invalid_stream_timing"}


def test_srt_golden(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "one"), (1, 1, 1.0, 2.0, " two\n words ")], "media_id int, ord int, start double, end double, text string")
    pauses = spark.createDataFrame([(1, 1.0, .75)], "media_id int, at double, duration double")
    doc = wr.to_srt(seg, pauses).first().document
    assert doc == "1\n00:00:00,000 --> 00:00:01,750\none\n\n2\n00:00:01,750 --> 00:00:02,750\ntwo words\n"
    assert tl.shift_by_pauses(seg.select("media_id", "start"), pauses, "start").filter("shifted = 1.75").count() == 1


def test_round_like_python(spark):
    rng = random.Random(1)
    values = [3.755 / 8, 0.469375, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, 0.125, 0.375, 1e-9, 1e17, -3.755 / 8, 0.0, 2.0005, 1234567.0005]
    values += [rng.randrange(-10**7, 10**7) / rng.choice([1000, 2000, 16000, 7, 3.1, 8e5]) for _ in range(3000)]
    values += [k / 10 ** n + 5 / 10 ** (n + 1) for n in (2, 3, 4, 5) for k in rng.sample(range(100000), 200)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (3, 4, 5):
        got = frame.select("x", round_exact("x", digits).alias("y")).collect()
        assert [r for r in got if r.y != round(r.x, digits)] == []
    assert spark.sql("SELECT CAST(NULL AS double) AS x").select(round_exact("x", 3)).first()[0] is None
