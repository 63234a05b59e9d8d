"""Files written and read back; damaged state kept aside."""

import hashlib
import json
import shutil

from cuelog.operators import events as ev
from cuelog.operators import jobs as jb
from cuelog.sources import readers as rd
from cuelog.sources import review as rv
from cuelog.sources import writers as wr


def _put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_checkpoints(spark, tmp_path):
    seg = [{"key": "k1", "start": 0.0, "end": 1.0, "source": "a", "translated": " b "}, {"key": "", "translated": "x"},
           {"key": "k2", "start": 1.0, "end": 2.0, "source": "c", "translated": "  "}]
    _put(tmp_path / "in" / "a.json", {"schema_version": 1, "input": {"path": "/m/a.mp4"}, "target_language": "ru", "segments": seg})
    _put(tmp_path / "in" / "b.json", {"schema_version": 2, "input": {"path": "/m/b.mp4"}, "target_language": "ru", "segments": seg})
    got = rd.read_checkpoints(spark, str(tmp_path / "in")).collect()
    assert [(r.media_id, r.key, r.translated) for r in got] == [("/m/a.mp4", "k1", "b")]
    pairs = spark.createDataFrame([("/m/a.mp4", "ru", 0.0, 1.0, " a ", "b")], "media_id string, target string, start double, end double, source string, translated string")
    wr.write_checkpoints(pairs, str(tmp_path / "out"))
    back = rd.read_checkpoints(spark, str(tmp_path / "out")).first()
    assert (back.media_id, back.target, back.source, back.translated, back.start, back.end) == ("/m/a.mp4", "ru", "a", "b", 0.0, 1.0)
    assert back.key == hashlib.sha256(b"0.000\n1.000\na").hexdigest()
    many = spark.range(25).selectExpr("'m' media_id", "'ru' target", "id + 0.0625 start", "id + 0.5D `end`", "concat('s', id) source", "concat('t', id) translated")
    wr.write_checkpoints(many, str(tmp_path / "many"), part_rows=10)
    got = rd.read_checkpoints(spark, str(tmp_path / "many"))
    assert got.count() == 25 and got.select("key").distinct().count() == 25
    assert len(list((tmp_path / "many").glob("part-*"))) == 3


def test_event_log(spark, tmp_path):
    root = tmp_path / "logs"
    name = "session_20260101_120000_000001_7"
    first = {"sequence": 1, "level": "info", "event": "stage_started", "message": "m", "details": {"stage": "asr", "files": {"items": ["a", "b"]}}}
    second = {"sequence": 2, "level": "error", "event": "x_failed", "details": {"exception": {"type": "E", "traceback": "t"}, "command": ["ffmpeg", "-i"]}}
    _put(root / name / "events.jsonl", json.dumps(first) + "\nnot json\n[1]\n")
    _put(root / name / "problems.jsonl", json.dumps(second) + "\n")
    _put(root / name / "events.jsonl.1", json.dumps({"sequence": 0, "event": "older"}) + "\n")
    _put(root / name / "manifest.json", {"schema_version": 1, "artifact_type": "problem_session", "session_id": "s1", "status": "closed", "updated_at": "2026"})
    _put(root / "session_bad" / "manifest.json", {"schema_version": 1, "artifact_type": "problem_session", "session_id": "s2"})
    log = {r.sequence: r for r in rd.read_event_log(spark, str(root)).collect()}
    assert sorted(log) == [0, 1, 2] and log[1].stage == "asr" and log[1].files == ["a", "b"]
    assert log[2].has_traceback and log[2].command == "ffmpeg -i" and log[2].session_id == name
    diagnosed = ev.diagnose(rd.read_event_log(spark, str(root)))
    assert {r.sequence: r.family for r in diagnosed.collect()} == {0: "runtime", 1: "runtime", 2: "external_process"}
    assert [r.session_id for r in rd.read_sessions(spark, str(root), "problem_session").collect()] == ["s1"]
    wr.write_event_log(diagnosed, str(tmp_path / "split"))
    again = {r.sequence: r for r in rd.read_event_log(spark, str(tmp_path / "split")).collect()}
    assert sorted(again) == [0, 1, 2] and again[1].stage == "asr" and again[1].files == ["a", "b"] and again[2].session_id == name
    assert again[2].has_traceback and again[2].command == "ffmpeg -i" and (again[1].level, again[2].level) == ("info", "error")
    shutil.copy(root / name / "events.jsonl", tmp_path / "alone.jsonl")
    _put(tmp_path / "one" / "s9" / "events.jsonl.2", json.dumps(first) + "\n")
    assert [r.session_id for r in rd.read_event_log(spark, str(tmp_path / "one")).collect()] == ["s9"]


def test_glossary(spark, tmp_path):
    _put(tmp_path / "g.json", {" RAM  disk ": " диск ", "": "x", "b": " "})
    assert [tuple(r) for r in rd.read_glossary(spark, str(tmp_path / "g.json")).collect()] == [("RAM disk", "диск", 0)]
    _put(tmp_path / "bom.json", "\ufeff" + json.dumps({"a": "b"}))
    assert [tuple(r) for r in rd.read_glossary(spark, str(tmp_path / "bom.json")).collect()] == [("a", "b", 0)]


def test_queue_and_quarantine(spark, tmp_path):
    task = {"task_id": "t1", "status": "odd", "batch_state": {"status": "running", "files": [
        {"file_index": "x", "input": {"path": "a.mp4", "size": 5}, "elapsed_sec": -1}, 7]}, "runtime": {"progress": "bad"}}
    _put(tmp_path / "q" / "a.json", {"schema_version": 1, "tasks": [task, {"status": "queued"}], "known_task_batch_ids": ["k", " k ", "z"]})
    _put(tmp_path / "q" / "b.json", {"schema_version": 9, "tasks": []})
    _put(tmp_path / "q" / "c.json", "{broken")
    tasks, files, known = rd.read_tasks(spark, str(tmp_path / "q"))
    row = jb.normalize_tasks(tasks).first()
    assert (row.task_id, row.status, row.progress) == ("t1", "interrupted", 0)
    fixed = sorted((r.file_index, r.status, r.elapsed_sec, r.input_path) for r in jb.normalize_files(files).collect())
    assert fixed[0] == (1, "pending", 0.0, "a.mp4") and len(fixed) == 2
    assert sorted(r.task_id for r in jb.dedupe_keep_first(known, "task_id", "ord").collect()) == ["k", "z"]
    labels = {r.file.rsplit("/", 1)[1]: r.label for r in rd.quarantined_tasks(spark, str(tmp_path / "q")).collect()}
    assert labels == {"a.json": "partial", "b.json": "unsupported", "c.json": "corrupt"}


def test_probe_and_inventory(spark, tmp_path):
    _put(tmp_path / "p" / "m.json", {"format": {"duration": "10.5"}, "streams": [
        {"index": 0, "codec_type": "video", "duration": "N/A", "avg_frame_rate": "30000/1001", "disposition": {"default": 1, "attached_pic": 0}},
        {"index": 1, "codec_type": "audio", "duration": "10.4", "avg_frame_rate": "0/0"}]})
    rows = {r.kind: r for r in rd.read_media_probe(spark, str(tmp_path / "p")).collect()}
    assert rows["video"].duration is None and abs(rows["video"].fps - 29.97) < .01 and rows["video"].is_default
    assert rows["audio"].fps is None and rows["audio"].start_time == 0.0
    for name in ("a" * 64 + ".mp3", "a" * 64 + ".json", "." + "b" * 64 + ".1.tmp", "note.txt"):
        _put(tmp_path / "c" / name, "12345")
    found = rd.read_inventory(spark, str(tmp_path / "c"))
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.size) for r in found.collect()}
    assert kinds["a" * 64 + ".mp3"] == ("entry", 5) and kinds["note.txt"][0] == "other"
    listing = spark.createDataFrame([("/c/." + "b" * 64 + ".1.tmp", 5, 1)], "path string, size bigint, mtime bigint")
    hidden = rd.classify_inventory(listing, "/c").first()
    assert (hidden.kind, hidden.key) == ("temporary", "b" * 64)


def test_review_round_trip(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0, 5.0, "a", "b\nc"), (1, 2, 5.0, 6.0, "d", "e")],
                                  "media_id int, seg_index int, start double, end double, source string, translated string")
    docs = rv.export_review(pairs)
    text = docs.first().document
    assert "### 001 | 00:00 -> 00:05" in text
    edited = spark.createDataFrame([(1, text.replace("e\n### END", "E!\r\n### END"))], "media_id int, document string")
    assert {r.seg_index: r.edited for r in rv.import_review(edited).collect()} == {1: "b\nc", 2: "E!"}


def test_reports(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 1, 0.0, 61.0, "a", "b")], "media_id int, seg_index int, start double, end double, source string, translated string")
    assert wr.to_segment_report(pairs, "en", "ru").first().document == "[001] 00:00 → 01:01\nSRC (en): a\nRU: b\n"
    assert wr.to_transcript(pairs.withColumnRenamed("seg_index", "ord")).first().text == "b"
    pauses = spark.createDataFrame([(1, 2.0, .5, [3, 4])], "media_id int, at double, duration double, segments array<bigint>")
    assert wr.to_pause_report(pauses).first().document == "001. 00:02 +0.50s for segments: 3, 4"
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "one")], "media_id int, ord int, start double, end double, text string")
    wr.write_srt(seg, pauses.select("media_id", "at", "duration"), str(tmp_path / "srt"))
    assert "00:00:00,000 --> 00:00:01,000" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "srt")).collect())
    sessions = spark.createDataFrame([("a", "closed", "2026-01-01"), ("b", "running", "2026-01-02")], "session_id string, status string, updated_at string")
    assert wr.latest_session(sessions).first().session_id == "b" and wr.session_manifest(sessions).count() == 2


def test_many_sessions_share_log_files(spark, tmp_path):
    rows = [(f"s{i}" if i else None, i, "error" if i % 3 == 0 else "info", "stage_started", "asr") for i in range(40)]
    events = spark.createDataFrame(rows, "session_id string, sequence bigint, level string, event string, stage string").coalesce(2)
    for by_session in (False, True):
        path = tmp_path / f"logs{by_session}"
        wr.write_event_log(events.filter("session_id IS NOT NULL") if by_session else events, str(path), by_session)
        back = rd.read_event_log(spark, str(path)).select("session_id", "sequence", "level", "event", "stage").collect()
        assert sorted(map(tuple, back), key=lambda r: r[1]) == rows[int(by_session):]
        assert (len(list(path.rglob("part-*.txt"))) <= 4) != by_session


def test_short_checkpoints_share_files(spark, tmp_path):
    pairs = spark.range(60).selectExpr("concat('m', id) media_id", "'ru' target", "0D start", "1D `end`", "concat('s\\n', id) source", "concat('t', id) translated")
    for own_files in (False, True):
        path = tmp_path / f"stored{own_files}"
        wr.write_checkpoints(pairs, str(path), own_files=own_files)
        assert rd.read_checkpoints(spark, str(path)).select("media_id", "translated").distinct().count() == 60
        assert (len(list(path.glob("part-*"))) < 60) != own_files
    _put(tmp_path / "storedFalse" / "a.json", json.dumps({"schema_version": 1, "input": {"path": "/m/a.mp4"}, "target_language": "ru", "segments": [{"key": "k", "translated": "b"}]}, indent=1))
    assert rd.read_checkpoints(spark, str(tmp_path / "storedFalse")).count() == 61
