"""Streams against loops and against their batch twins."""

import json
import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cuelog.operators import events as ev
from cuelog.streaming import live as lv
from cuelog.streaming import machines as mc


def _stream(spark, tmp_path, df, files=3, order="seq"):
    """``df`` written as several files in order, and read back one file a trigger."""
    rows, folder = df.orderBy(order).collect(), tmp_path / "in"
    folder.mkdir()
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        text = "\n".join(json.dumps(r.asDict(), default=str) for r in rows[i:i + size])
        file = folder / f"{i:06d}.json"
        file.write_text(text)
        os.utime(file, (1700000000 + i, 1700000000 + i))  # the source takes older files first
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_storm_golden(spark, tmp_path):
    calls = [("edge", float(t), i, "failure") for i, t in enumerate((0, 1, 2, 3, 4, 5))]
    calls += [("edge", 10.0, 6, "request"), ("edge", 20.0, 7, "success"), ("edge", 40.0, 8, "request"), ("edge", 41.0, 9, "request"),
              ("edge", 42.0, 10, "success"), ("edge", 43.0, 11, "success"), ("edge", 44.0, 12, "success"), ("edge", 45.0, 13, "request")]
    df = spark.createDataFrame(calls, "service string, ts double, seq bigint, kind string")
    got = [(r.seq, r.event, r.claim) for r in lv.drain(mc.detect_storms(_stream(spark, tmp_path, df))).orderBy("seq").collect()]
    assert got == [(5, "started", None), (6, "request", "bypass"), (8, "request", "probe"), (9, "request", "bypass"),
                   (12, "finished", None), (13, "request", "normal")]


def test_circuit_batch_equals_steps(spark, tmp_path):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([1, 20, 100, 700])
        rows.append((rng.choice(["a", "a", "b"]), float(t), i, rng.choice([None, "rate_limit", "rate_limit", "timeout"])))
    df = spark.createDataFrame(rows, "provider string, ts double, seq bigint, reason string")
    want = {}
    for name in ("a", "b"):
        mine = [r for r in rows if r[0] == name]
        for k, (_, ts, seq, reason) in enumerate(mine):
            back = next((j for j in range(k, -1, -1) if mine[j][3] is None), -1)  # the last success so far
            run = next(n for n in range(k + 2) if n > k or mine[k - n][3] != reason) if reason else 0
            ends = []
            for j in range(back + 1, k + 1):
                length = next(n for n in range(j + 2) if n > j or mine[j - n][3] != mine[j][3])
                ends.append(mine[j][1] + (min(60.0 * 2 ** min(length - 1, 4), 900.0) if mine[j][3] == "rate_limit" else 60.0))
            want[seq] = (run, max(ends, default=0.0))
    batch = {r.seq: (r.streak, r.cooldown_until, r.available) for r in mc.provider_circuit(df).collect()}
    assert {k: v[:2] for k, v in batch.items()} == want
    live = lv.drain(mc.provider_circuit_stream(_stream(spark, tmp_path, df)))
    assert {r.seq: (r.streak, r.cooldown_until, r.available) for r in live.collect()} == batch


def test_storms_do_not_depend_on_triggers(spark):
    """Whole, in pieces and answer by answer, the timeline is the same; pauses hold back requests."""
    rng = random.Random(21)
    for rules in (mc.StormRules(3, 30, 10, 2, 5), mc.StormRules(2, 20, 10, 2, 8, 6), mc.StormRules(1, 5, 10, 1)):
        t, rows = 0.0, []
        for _ in range(400):
            t += rng.choice([0, 1, 3, 9, 25])
            rows.append((t, rng.choice(["failure", "failure", "success", "success", "request"])))
        seen = []
        for size in (1, 7, 400):
            memory, out = mc.Outage([]), []
            for k in range(0, 400, size):
                part = rows[k:k + size]
                answers = [r for r in part if r[1] != "request"]
                before = [sum(x[1] != "request" for x in part[:i]) for i, r in enumerate(part) if r[1] == "request"]
                start, asked = memory.until, memory.asked
                reports, pauses = mc.outage_timeline(memory, np.array([a[0] for a in answers]), np.array([a[1] == "failure" for a in answers], bool), rules)
                claims, probed = mc.request_claims(np.array(before, int), np.array([r[0] for r in part if r[1] == "request"]), start, asked, pauses)
                memory.asked = len(answers) in probed or (asked and not answers)
                out.append(([(answers[i][0], r) for i, r in reports], claims))
            seen.append(([r for reports, _ in out for r in reports], [c for _, claims in out for c in claims]))
        assert seen[0] == seen[1] == seen[2]
        events = [r["event"] for _, r in seen[0][0]]
        assert {"started", "finished", "extended"} <= set(events) and {"normal", "probe", "bypass"} <= set(seen[0][1])
        calm = [e for e in events if e != "extended"]
        assert calm == ["started", "finished"] * (len(calm) // 2) + ["started"] * (len(calm) % 2)


def test_circuit_golden(spark):
    df = spark.createDataFrame([("g", 0.0, 0, "rate_limit"), ("g", 0.0, 1, "rate_limit"), ("g", 0.0, 2, "rate_limit"), ("g", 1.0, 3, None),
                                ("g", 2.0, 4, "rate_limit")], "provider string, ts double, seq bigint, reason string")
    assert [r.cooldown_until for r in mc.provider_circuit(df).orderBy("seq").collect()] == [60.0, 120.0, 240.0, 0.0, 62.0]


def test_sampling_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, "tts_retry" if i % 3 else "other", f"sig{i % 3 % 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "session_id string, sequence bigint, event string, signature string")
    live = lv.drain(mc.sample_repeats_stream(_stream(spark, tmp_path, df, order="sequence")))
    batch = ev.sample_repeats(df).select("sequence", "occurrence", "stored")
    assert sorted(map(tuple, live.select("sequence", "occurrence", "stored").collect())) == sorted(map(tuple, batch.collect()))


def test_stalls_stream(spark, tmp_path):
    times = [("a", 0), ("a", 60), ("b", 100), ("b", 5000), ("c", 9000), ("c", 9001)]
    df = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(times)], "session_id string, seq bigint, t bigint")
    stream = _stream(spark, tmp_path, df, files=6).withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.session_id, r.last_seen.timestamp()) for r in lv.drain(mc.detect_stalls_stream(stream, 900, "10 seconds")).collect()}
    assert ("a", 60.0) in got and not any(s == "c" for s, _ in got)


def test_live_summary_stream_and_intake(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "s1").mkdir(parents=True)
    lines = [{"sequence": i, "level": "error" if i % 4 == 0 else "info", "event": "stage_started", "details": {"stage": f"st{i}"}} for i in range(1, 13)]
    for part in range(3):
        file = root / "s1" / f"events.jsonl.{part}"
        file.write_text("\n".join(json.dumps(x) for x in lines[part * 4:part * 4 + 4]))
        os.utime(file, (1700000000 + part, 1700000000 + part))
    stream = lv.stream_event_log(spark, str(root), max_files=1)
    query = (lv.live_summary(stream).writeStream.format("memory").queryName("live").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    row = spark.table("live").first()
    assert (row.session_id, row.events, row.errors, row.stage, row.last_sequence) == ("s1", 12, 3, "st12", 12)


def test_sampling_stream_state_does_not_grow_with_sessions(spark, tmp_path):
    """Python is called, and state is kept, once a group of sessions; the numbers are those of the batch."""
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(1500)}", i, rng.choice(["tts_retry", "other"]), f"sig{rng.randrange(3)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "session_id string, sequence bigint, event string, signature string")
    folder = str(tmp_path / "out")
    query = (mc.sample_repeats_stream(_stream(spark, tmp_path, df, order="sequence")).writeStream.format("parquet").option("path", folder)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    columns = ["session_id", "signature", "sequence", "occurrence", "stored"]
    batch = ev.sample_repeats(df).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(folder).select(*columns).collect())) == sorted(map(tuple, batch.collect()))


class _State:
    """The state of one group, with a clock that the test sets."""
    hasTimedOut, now, value, due = False, 0, None, None
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_sampling_forgets_buckets_apart():
    """Of two buckets in a group, the one unseen for the time to live is forgotten, the other counts on."""
    run, state = mc._repeat_sampler({"tts_retry"}, 100), _State()

    def see(now, *rows):
        state.now, state.hasTimedOut = now, not rows
        frames = [pd.DataFrame([(*r, "tts_retry", f"{r[3]}:{r[0]}", f"{r[0]}={r[1]}") for r in rows],
                               columns=["session_id", "signature", "sequence", "bucket", "event", "unit", "key"])] if rows else []
        return [n for out in run((0,), iter(frames), state) for n in out["occurrence"]]

    assert see(0, ("a", "x", 1, 0), ("a", "y", 2, 0), ("b", "x", 3, 1), ("b", "x", 4, 1)) == [1, 1, 1, 2] and state.due == 100
    assert see(60, ("a", "x", 5, 0)) == [2] and state.due == 100
    assert see(100) == [] and state.due == 160  # b is forgotten; a, with its y, is not
    assert see(120, ("b", "x", 6, 1), ("a", "y", 7, 0)) == [1, 2] and state.due == 220
    assert see(220) == [] and state.value is None
