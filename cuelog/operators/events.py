"""Problem logs: signatures, occurrence sampling, roll-ups, issue cards and verdicts.

Events carry ``session_id``, ``sequence`` (unique and rising per session), ``ts``,
``level``, ``event``, ``message`` and, where known, the columns in ``DETAIL_COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..functions.classify import error_category, problem_family
from ..functions.keys import short_hash
from ..functions.text import redact, signature_text

SESSION = ["session_id"]
BLOCK_ROWS = 50000
DETAIL_COLUMNS = {
    "stage": "string", "input_path": "string", "service": "string", "component": "string", "provider": "string",
    "exc_type": "string", "exc_category": "string", "exc_message": "string", "has_traceback": "boolean",
    "command": "string", "returncode": "string", "validation_reason": "string",
}
# ---- fixed values: event names, sampling points and whitelisted keys ----
SAMPLED_EVENTS = [
    "activity_heartbeat", "manual_review_still_waiting", "runtime_error_log", "runtime_warning_log",
    "translation_retry", "translation_retry_recovered", "translation_provider_response_rejected",
    "translation_provider_endpoint_switched", "translation_checkpoint_entry_rejected",
    "translation_segment_deferred", "translation_progress", "tts_edge_probe_failed", "tts_gtts_retry", "tts_retry",
]
SAMPLE_POINTS = [5, 10, 20, 50, 100]
CONTEXT_KEYS = [
    "service", "operation", "provider", "provider_from", "provider_to", "primary_backend", "fallback_backend",
    "endpoint", "returncode", "return_code", "file_index", "files_total", "segment_index", "tts_segment_index",
    "attempt", "attempts_total", "max_attempts", "failure_kind", "impact", "recovery_action", "checkpoint_path",
    "source_length", "source_sha256", "source_preview", "invalid_count", "rejected_checkpoint_entries",
    "elapsed_sec", "timeout_sec", "ffmpeg_completed_ok", "expected_video_duration_sec",
    "expected_audio_duration_sec", "source_video_fps", "pause_count", "raw_pause_total_sec",
    "effective_video_pause_sec", "pause_frame_quantization_delta_sec",
]
RESPONSE_EVENTS = ["translation_provider_response_rejected", "translation_checkpoint_entry_rejected",
                   "translation_integrity_invalid_provider_response"]
RATE_LIMIT_EVENTS = ["translation_rate_limit_detected", "translation_batch_deferred_provider_unavailable",
                     "translation_provider_circuit_opened", "translation_provider_probe_failed"]
CRITICAL_EVENTS = ["worker_thread_crashed", "application_startup_failed"]
# ---- end of fixed values ----

#: Advice per playbook: (playbook, what usually lies behind it, what to do, how to know that it worked).
PLAYBOOKS = [
    ("network_retry", "The line to an outside service drops or is throttled.", "Let the retries run out, wait for the pause to end, then continue from stored progress.",
     "A second run gets past this point, or stops with a single error and nothing lost."),
    ("translation_rate_limit", "Too many requests were sent from here, or the translator is unreachable.", "Use another endpoint where there is one; otherwise pause, try once, and stop early.",
     "Request counts stay flat while the limit lasts."),
    ("media_validation", "Audio and video of a result have lengths that do not agree with the plan.", "Put planned and measured lengths side by side, stream by stream.",
     "An intact result is accepted and a shortened one is not."),
    ("user_cancel", "Work was stopped on request.", "Nothing to mend if someone did ask for it.", "The stopped work can be taken up again."),
    ("translation_provider_response", "An error page was taken for a translation.", "Reject such text before it is stored or spoken, and ask again.", "No stored entry contains an error page."),
    ("translation_tts", "A single phrase failed in translation or synthesis.", "Look at that phrase, its provider and the error; leave the finished ones alone.", "Only the failed phrases are done again."),
    ("ffmpeg_process", "The encoder exited with an error or without finishing.", "Read the last lines it printed and repeat its command by hand.", "The repeated command yields a file that can be probed."),
    ("files_paths", "A path does not exist, is locked, or cannot be written.", "Look at rights, length and duplicates of the path.", "The same path works."),
    ("recovery_cache", "Saved progress is outdated, foreign or incomplete.", "Compare it with the present input and discard only what differs.", "After an interruption, finished items are not repeated."),
    ("application_exception", "A fault in the program itself.", "Go to the place that raised it first.", "A test reproduces the fault and passes once it is mended."),
]

# ---- fixed values: categories by which improvements are grouped ----
#: Improvement candidates by category: (area, categories, priority with errors, priority without, needs errors).
CATEGORY_RULES = [
    ("translation_response_validation", ["translation_provider_response"], "high", "high", False),
    ("network_and_tts", ["network", "network_timeout", "connection", "text_to_speech"], "high", "medium", False),
    ("media_validation", ["media_validation"], "high", "high", False),
    ("ffmpeg_pipeline", ["external_process", "subprocess", "ffmpeg"], "high", "high", False),
    ("files_and_paths", ["file_pipeline", "file_access", "permission", "path"], "high", "medium", False),
    ("recovery", ["recovery_and_cache", "cache"], "medium", "medium", False),
    ("application_code", ["application", "runtime", "unknown"], "high", "high", True),
]
# ---- end of fixed values ----


def with_details(events: DataFrame) -> DataFrame:
    """Add the detail columns a log lacks, as NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in DETAIL_COLUMNS.items() if c not in events.columns}
    return events.withColumns(missing) if missing else events


def diagnose(events: DataFrame) -> DataFrame:
    """Redact messages and add category, family, signature and actionability.

    A log without the column ``exc_category`` gets it from the exception itself.
    """
    rows = with_details(events).withColumn("message", redact("message", 6000))
    if "exc_category" not in events.columns:
        rows = rows.withColumn("exc_category", F.when(
            F.col("exc_type").isNotNull(), error_category("exc_type", "exc_message")))
    rows = rows.withColumn("family", problem_family("event", "exc_category", "command"))
    signature = short_hash(
        F.col("event"), F.col("level"), F.col("family"), signature_text("message"), F.col("stage"),
        F.coalesce("service", "component"), F.col("provider"), F.lower("exc_type"), F.lower("exc_category"),
        signature_text("exc_message"), signature_text("command"), F.col("returncode"), F.col("validation_reason"))
    return (rows.withColumn("signature", signature).withColumn("is_problem", F.col("level").isin("warning", "error"))
            .withColumn("actionability", actionability("level")))


def actionability(level: str) -> Column:
    return F.when(F.col(level) == "error", "investigate").when(F.col(level) == "warning", "review").otherwise("context")


def problems(events: DataFrame) -> DataFrame:
    """Warnings and errors only."""
    return events.filter(F.col("level").isin("warning", "error")).withColumn("actionability", actionability("level"))


def number_occurrences(events: DataFrame) -> DataFrame:
    """Running number of each signature within its session."""
    return o.ordered_scan(events, [*SESSION, "signature"], ["sequence"], o.every("sequence", BLOCK_ROWS),
                          occurrence=o.row_number())


def stored_occurrence(event: str = "event", occurrence: str = "occurrence",
                      sampled: list[str] | None = None) -> Column:
    """Which repeats are kept: all of ordinary events, sparse ones of chatty events."""
    n = F.col(occurrence)
    keep = (n <= 3) | n.isin(SAMPLE_POINTS) | (n % 250 == 0)
    return ~F.col(event).isin(sampled or SAMPLED_EVENTS) | keep


def stored_of(total: str, event: str = "event", sampled: list[str] | None = None) -> Column:
    """How many of the first ``total`` occurrences :func:`stored_occurrence` keeps."""
    n = F.col(total)
    sparse = F.least(n, F.lit(3)) + F.floor(n / 250)
    for point in SAMPLE_POINTS:
        sparse = sparse + F.when(n >= point, 1).otherwise(0)
    return F.when(F.col(event).isin(sampled or SAMPLED_EVENTS), sparse).otherwise(n).cast("bigint")


def sample_repeats(events: DataFrame, sampled_events: list[str] | None = None) -> DataFrame:
    """Add ``occurrence`` and ``stored``."""
    return number_occurrences(events).withColumn("stored", stored_occurrence(sampled=sampled_events))


def event_counters(events: DataFrame, by: str) -> DataFrame:
    """Events per session by level, event or category (exception category, else family)."""
    key = F.coalesce("exc_category", "family") if by == "category" else F.col(by)
    return events.groupBy("session_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def carry_context(events: DataFrame, block: str | None = None) -> DataFrame:
    """Latest known stage and input path on every event; a closed session's stage is 'closed'.

    ``block``: a column that cuts the sequence into blocks, kept in the result.
    """
    stage = F.when(F.col("event") == "app_session_finished", "closed").otherwise(F.nullif("stage", F.lit("")))
    carried = o.ordered_scan(events, SESSION, ["sequence"], block or o.every("sequence", BLOCK_ROWS),
                             stage_cf=o.last_known(stage), input_path_cf=o.last_known(F.nullif("input_path", F.lit(""))))
    return carried.withColumn("stage_cf", F.coalesce("stage_cf", F.lit("startup")))


#: What a session's latest problems are after some events: the signatures seen last, newest at the end; how many came back
#: after they had left that list; and, for events in the middle of a session, the first ones of each signature
#: as long as the list is not full: whether those came back depends on the events before.
_LATEST = "named_struct('recent', cast(array() AS array<string>), 'gone', 0L, 'open', cast(array() AS array<struct<signature:string,again:boolean>>))"


def _seen_last(before: str, item: str, n: int) -> str:
    """``before`` with ``item`` moved or added to its end, and not longer than ``n``."""
    moved = f"array_append(array_remove({before}, {item}), {item})"
    return f"slice({moved}, greatest(size({moved}) - {n - 1}, 1), {n})"


def _latest_of_block(rows: str, n: int) -> Column:
    """Sum up the problems of one block, an array of (sequence, signature, again)."""
    new, full = "NOT array_contains(a.recent, r.signature)", f"size(a.recent) >= {n}"
    return F.expr(f"""aggregate(array_sort({rows}), {_LATEST}, (a, r) -> named_struct(
        'recent', {_seen_last('a.recent', 'r.signature', n)},
        'gone', a.gone + if(r.again AND {full} AND {new}, 1L, 0L),
        'open', if({new} AND NOT {full}, array_append(a.open, named_struct('signature', r.signature, 'again', r.again)), a.open)))""")


def _gone_in_session(blocks: str, n: int) -> Column:
    """How many problems of a session came back after they had left the ``n`` seen last, from its blocks, (block, latest).

    Replaying a block's open events tells which of them the list of the blocks before still holds;
    then the block's own list goes over it.
    """
    start = "named_struct('recent', cast(array() AS array<string>), 'gone', 0L)"
    replay = f"""aggregate(b.latest.open, s, (t, r) -> named_struct('recent', {_seen_last('t.recent', 'r.signature', n)},
        'gone', t.gone + if(r.again AND NOT array_contains(t.recent, r.signature), 1L, 0L)))"""
    after = f"""aggregate(b.latest.recent, {replay}, (t, x) -> named_struct('recent', {_seen_last('t.recent', 'x', n)}, 'gone', t.gone),
        t -> named_struct('recent', t.recent, 'gone', t.gone + b.latest.gone))"""
    return F.expr(f"aggregate(array_sort({blocks}), {start}, (s, b) -> {after}, s -> s.gone)")


def diagnostics_quality(events: DataFrame, recent: int = 20) -> DataFrame:
    """Log-quality counts per session, from diagnosed events.

    Counted by blocks of a session, then by session.  A block's list of the ``recent`` problems seen last is a summary of
    bounded size, so ``problem_signatures_outside_recent_window`` (problems that came back after
    so many others that they had left that list) needs no window over a whole session.
    """
    seen = carry_context(sample_repeats(events).withColumn("_part", o.every("sequence", BLOCK_ROWS)), "_part")
    bad, error = F.col("is_problem"), F.col("level") == "error"
    stage, path = F.coalesce(F.nullif("stage", F.lit("")), "stage_cf") != "", F.col("input_path_cf").isNotNull()
    trace = F.coalesce("has_traceback", F.lit(False))
    size = F.octet_length(F.to_json(F.struct("session_id", "sequence", "level", "event", "message", "signature")))
    counts = {
        "events_total": F.lit(True), "problem_events_total": bad, "error_events_total": error,
        "problems_with_stage": bad & stage, "problems_with_input_path": bad & path,
        "problems_missing_stage_and_input": bad & ~stage & ~path,
        "errors_without_traceback": error & ~trace, "exceptions_with_traceback": bad & trace,
        "records_stored_total": F.col("stored"), "problem_events_stored": F.col("stored") & bad,
        "timeline_events_stored": F.col("stored") & ~bad, "repeat_events_compacted": ~F.col("stored"),
        # a signature holds the level, so all its events are problems or none
        "unique_problem_signatures_total": bad & (F.col("occurrence") == 1),
    }
    problem = F.when(bad & F.col("signature").isNotNull(), F.struct("sequence", "signature", (F.col("occurrence") > 1).alias("again")))
    blocks = seen.groupBy("session_id", "_part").agg(
        *[F.count_if(test).alias(name) for name, test in counts.items()],
        F.sum(F.when(~F.col("stored"), size)).alias("estimated_bytes_saved"), F.collect_list(problem).alias("_problems"))
    blocks = blocks.withColumn("_latest", _latest_of_block("_problems", recent))
    return blocks.groupBy("session_id").agg(
        *[F.sum(name).alias(name) for name in counts],
        F.coalesce(F.sum("estimated_bytes_saved"), F.lit(0)).alias("estimated_bytes_saved"),
        F.collect_list(F.struct(F.col("_part").alias("block"), F.col("_latest").alias("latest"))).alias("_blocks")).withColumn(
        "problem_signatures_outside_recent_window", _gone_in_session("_blocks", recent)).drop("_blocks")


def signature_rollup(events: DataFrame) -> DataFrame:
    """One row per problem signature and session, from diagnosed events.

    The stage and input path are those known when the problem first came up.
    """
    seen = carry_context(events).filter("is_problem")
    first = F.struct("ts", "sequence", "event", "level", "message", "family", "exc_category",
                     F.coalesce("stage", "stage_cf").alias("stage"), F.coalesce("input_path", "input_path_cf").alias("input_path"))
    last = F.struct("ts", "sequence", "exc_message", "service", "provider", "returncode")
    rolled = seen.groupBy("session_id", "signature").agg(
        F.count(F.lit(1)).alias("occurrences_total"),
        F.min_by(first, "sequence").alias("f"), F.max_by(last, "sequence").alias("l"))
    return rolled.select(
        "session_id", "signature", "occurrences_total", stored_of("occurrences_total", "f.event").alias("stored_samples"),
        "f.event", "f.level", "f.message", "f.family",
        F.coalesce("f.exc_category", "f.family").alias("category"), "f.stage", "f.input_path",
        F.col("f.ts").alias("first_ts"), F.col("l.ts").alias("last_ts"), F.col("f.sequence").alias("first_sequence"),
        F.col("l.sequence").alias("last_sequence"), F.col("l.exc_message").alias("last_exception"),
        F.struct("l.service", "l.provider", "l.returncode").alias("last_context"))


def recent_problems(rollup: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` signatures seen last, per session."""
    order = Window.partitionBy("session_id").orderBy(F.desc("last_sequence"))
    return rollup.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def issue_cards(rollup: DataFrame) -> DataFrame:
    """Add priority, state, playbook and cause status to rolled-up problems."""
    event, family = F.col("event"), F.coalesce("category", "family")
    terminal = (F.col("level") == "error") | event.rlike("(_failed|_crashed)$")
    priority = (F.when(event.isin(CRITICAL_EVENTS), "critical").when(terminal, "high")
                .when(F.col("occurrences_total") >= 3, "medium").otherwise("low"))
    response = event.isin(RESPONSE_EVENTS) | (family == "translation_provider_response")
    limited = event.isin(RATE_LIMIT_EVENTS) | ((family == "rate_limit") & (F.coalesce("stage", F.lit("")) == "translation"))
    network = family.isin("network", "network_timeout", "network_connection", "rate_limit", "timeout")
    playbook = (F.when(response, "translation_provider_response").when(limited, "translation_rate_limit")
                .when(network, "network_retry").when(event == "file_pipeline_cancelled", "user_cancel")
                .when(family.isin("text_to_speech", "translation"), "translation_tts")
                .when(family == "media_validation", "media_validation")
                .when(family.isin("external_process", "subprocess_failed", "ffmpeg"), "ffmpeg_process")
                .when(family.isin("file_pipeline", "file_not_found", "permission_denied", "file_access", "path"), "files_paths")
                .when(family.isin("recovery_and_cache", "cache"), "recovery_cache")
                .otherwise("application_exception"))
    status = (F.when(F.col("playbook") == "translation_provider_response", "confirmed_invalid_provider_payload")
              .when((F.col("playbook") == "translation_rate_limit") & (event == "translation_provider_probe_failed"),
                    "confirmed_provider_unavailable_after_cooldown")
              .when(F.col("playbook") == "user_cancel", "confirmed_user_action_if_app_close_requested_precedes")
              .otherwise("likely_not_proven"))
    return (rollup.withColumn("priority", priority)
            .withColumn("state", F.when(terminal, "terminal_failure").otherwise("retry_or_warning"))
            .withColumn("playbook", playbook).withColumn("cause_status", status))


def playbook_table(spark) -> DataFrame:
    return spark.createDataFrame(PLAYBOOKS, "playbook string, likely_cause string, recommended_fix string, verification string")


def attach_playbooks(cards: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Add the advice of each card's playbook (a ten-row table)."""
    return cards.join(playbooks, "playbook", "left")


def rank_issue_cards(cards: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` leading cards per session with their rank and how many were left out."""
    place = F.array_position(F.array(*[F.lit(p) for p in ("critical", "high", "medium", "low")]), F.col("priority"))
    order = Window.partitionBy("session_id").orderBy(place, F.desc("occurrences_total"), "last_sequence")
    totals = cards.groupBy("session_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("omitted"))
    ranked = cards.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(totals, "session_id")


def top_events(events: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` most frequent events per session."""
    order = Window.partitionBy("session_id").orderBy(F.desc("n"), "event")
    counts = events.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pair_incidents(events: DataFrame) -> DataFrame:
    """Every service outage with its end; one still open when its session closed is unresolved."""
    storms = events.filter(F.col("event").isin("network_storm_started", "network_storm_finished")).withColumn(
        "service", F.coalesce("service", F.lit("network")))
    paired = o.ordered_scan(storms, [*SESSION, "service"], ["sequence"], o.every("sequence", BLOCK_ROWS),
                            _next=o.following(F.struct("event", "ts")))
    closed = events.filter("event = 'app_session_finished'").groupBy("session_id").agg(F.max("sequence").alias("_closed"))
    done = F.coalesce(F.col("_next.event") == "network_storm_finished", F.lit(False))
    return (paired.filter("event = 'network_storm_started'").join(closed, "session_id", "left").select(
        "session_id", "service", "sequence", F.col("ts").alias("started_at"),
        F.when(done, F.col("_next.ts")).alias("finished_at"),
        F.when(done, F.unix_micros("_next.ts") - F.unix_micros("ts")).alias("_us"),
        F.when(done, "finished").when(F.col("_closed") > F.col("sequence"), "unresolved").otherwise("open").alias("state"))
        .withColumn("duration_sec", F.round(F.col("_us") / 1e6, 3)).drop("_us"))


def session_status(sessions: DataFrame, as_of: Column, stale_sec: int = 900) -> DataFrame:
    """Running sessions without news become interrupted; input: session_id, status, updated_at (text)."""
    age = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(F.col("updated_at").try_cast("timestamp")))
    stale = age.isNull() | (age >= stale_sec)
    running = F.col("status") == "running"
    return (sessions.withColumn("age_sec", F.when(F.col("updated_at").try_cast("timestamp").isNotNull(), age))
            .withColumn("status", F.when(running & F.coalesce(F.col("age_sec") >= stale_sec, F.lit(True)), "interrupted")
                        .when(running, "possibly_active").otherwise(F.col("status"))))


def stage_durations(events: DataFrame) -> DataFrame:
    """Time per stage from stage_finished events; the median is over whole milliseconds."""
    spent = F.round("elapsed_sec", 3)
    return events.filter((F.col("event") == "stage_finished") & F.col("stage").isNotNull()).groupBy("stage").agg(
        F.count("elapsed_sec").alias("n"), F.avg("elapsed_sec").alias("avg_sec"),
        F.percentile(spent, 0.5).alias("p50_sec"), F.max("elapsed_sec").alias("max_sec"))


def union_logs(timeline: DataFrame, problem_log: DataFrame) -> DataFrame:
    """Both halves of a stored log; order by (session_id, sequence) where order matters."""
    return timeline.unionByName(problem_log, allowMissingColumns=True)


def rules_fired(categories: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules that share a category with the session."""
    hits = [F.when(F.arrays_overlap(categories, F.array(*[F.lit(c) for c in words])), F.lit(name))
            for name, words in rules.items()]
    return F.filter(F.array(*hits), lambda r: r.isNotNull())


def session_counters(events: DataFrame) -> DataFrame:
    """Errors, warnings, categories and response rejections per session, from diagnosed events."""
    bad = F.col("is_problem")
    return events.groupBy("session_id").agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"),
        F.array_sort(F.collect_set(F.when(bad, F.coalesce("exc_category", "family")))).alias("categories"),
        F.count_if(bad & F.col("event").isin(RESPONSE_EVENTS)).alias("rejected_responses"))


def previous_status(sessions: DataFrame, stale_sec: int = 900) -> DataFrame:
    """How the session before ended, per installation: ``session_id`` and ``previous_status`` (null: the first one).

    Input: installation, session_id, started and last_seen (timestamps), closed.  A session that did not close is interrupted
    once the next one of its installation starts ``stale_sec`` or more after its last sign of life, else it may still run.
    Sessions of one installation are in order of their start, then id; an installation is split over blocks of days.
    """
    ended = F.struct("closed", "last_seen")
    rows = sessions.select(F.coalesce(F.col("installation").cast("string"), F.lit("")).alias("_place"), "session_id", "started", "last_seen", "closed")
    seen = o.ordered_scan(rows, ["_place"], ["started", "session_id"], F.floor(F.unix_timestamp("started") / 86400), _before=o.previous(ended))
    quiet = F.unix_micros("started") - F.unix_micros("_before.last_seen") >= stale_sec * 1_000_000
    return seen.select("session_id", F.when(F.col("_before.closed"), "closed").when(quiet, "interrupted").when(
        F.col("_before").isNotNull(), "possibly_active").alias("previous_status"))


def session_verdict(counters: DataFrame, quality: DataFrame, pause: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """Result class, observations and improvement candidates per session.

    ``pause`` (optional): session_id, pause_ratio, fallback_segments, previous_status and, where known, artifact_errors.
    ``cards`` (optional): ranked issue cards, whose first one is the ``primary_issue_signature``.
    """
    rows = counters.join(quality.select("session_id", "problems_missing_stage_and_input", "errors_without_traceback",
                                        "problem_events_total", "unique_problem_signatures_total"), "session_id")
    rows = rows.join(pause, "session_id", "left") if pause is not None else rows.withColumns({
        "pause_ratio": F.lit(0.0), "fallback_segments": F.lit(0), "previous_status": F.lit(None).cast("string")})
    if "artifact_errors" not in rows.columns:
        rows = rows.withColumn("artifact_errors", F.lit(0))
    top = cards.filter("rank = 1").select("session_id", F.col("signature").alias("_top")) if cards is not None else None
    rows = rows.join(top, "session_id", "left") if cards is not None else rows.withColumn("_top", F.lit(None).cast("string"))
    ratio, voices = F.coalesce("pause_ratio", F.lit(0.0)), F.coalesce("fallback_segments", F.lit(0))
    broken = F.coalesce(F.col("previous_status") == "interrupted", F.lit(False))
    errors = F.col("errors") > 0
    repeats = F.col("problem_events_total") - F.col("unique_problem_signatures_total")
    noted = {"errors": errors, "warnings": F.col("warnings") > 0, "repeats": repeats > 0,
             "previous_session_interrupted": broken, "fallback_voice": voices > 0, "pauses": ratio >= 0.05}

    candidates = []
    for area, words, with_errors, without, needs in CATEGORY_RULES:
        fires = F.arrays_overlap("categories", F.array(*[F.lit(w) for w in words]))
        if area == "translation_response_validation":
            fires = fires | (F.col("rejected_responses") > 0)
        if area == "recovery":
            fires = fires | broken
        if needs:
            fires = fires & errors
        candidates.append(F.when(fires, F.concat(F.when(errors, with_errors).otherwise(without), F.lit(f":{area}"))))
    candidates.insert(1, F.when(ratio >= 0.05, F.lit("medium:pause_sync_quality")))
    candidates.insert(2, F.when(voices > 0, F.lit("medium:tts_voice_consistency")))
    gaps = [F.when(F.col("problems_missing_stage_and_input") > 0, F.lit("high:missing_stage_and_input")),
            F.when(F.col("errors_without_traceback") > 0, F.lit("high:errors_without_traceback")),
            F.when(F.col("artifact_errors") > 0, F.lit("high:artifact_write_errors"))]

    def fired(items: list[Column], default: str) -> Column:
        kept = F.filter(F.array(*items), lambda c: c.isNotNull())
        return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)

    return rows.select(
        "session_id",
        F.when(errors, "errors_detected").when(F.col("warnings") > 0, "warnings_detected").otherwise(
            "no_problems_detected_yet").alias("result"),
        fired([F.when(test, F.lit(name)) for name, test in noted.items()], "nothing_recorded").alias("observations"),
        fired(candidates, "low:no_confirmed_change").alias("candidates"),
        fired(gaps, "low:no_gap_found").alias("logging_gaps"), "categories", F.coalesce("_top", F.lit("")).alias("primary_issue_signature"))


# ---------------------------------------------------------------- free-form details (JSON text)
def compact_context(events: DataFrame, details: str = "details") -> DataFrame:
    """The whitelisted, non-empty parts of ``details`` as the JSON text ``context``."""
    fields = ", ".join(f"{k} VARIANT" for k in CONTEXT_KEYS)
    parsed = events.withColumn("_d", F.from_json(details, fields)).withColumn("_x", F.from_json(details, """
        command VARIANT, stderr_tail STRING, stderr STRING, invalid_samples VARIANT,
        validation STRUCT<reason STRING, valid BOOLEAN, checks VARIANT, timing VARIANT>,
        response_validation STRUCT<valid BOOLEAN, reason STRING, signals ARRAY<STRING>, response_length BIGINT,
                                   response_sha256 STRING, preview STRING>"""))
    kept = [F.when(~F.to_json(F.col(f"_d.{k}")).isin('""', "[]", "{}", "null"), F.col(f"_d.{k}")).alias(k)
            for k in CONTEXT_KEYS]
    command = F.try_variant_get("_x.command", "$", "array<string>")
    samples = F.try_variant_get("_x.invalid_samples", "$", "array<variant>")
    errors = F.coalesce(F.nullif("_x.stderr_tail", F.lit("")), F.nullif("_x.stderr", F.lit("")))
    seen = F.col("_x.response_validation")
    extra = [
        F.when(F.size(command) > 0, F.slice(command, 1, 16)).alias("command_preview"),
        F.when(F.size(command) > 0, F.size(command)).alias("command_items_total"),
        F.when(errors.isNotNull(), redact(F.right(errors, F.lit(1000)), 1000)).alias("stderr_tail"),
        F.col("_x.validation").alias("validation"),
        F.when(seen.isNotNull(), seen.withField("preview", redact(seen["preview"], 500))).alias("response_validation"),
        F.when(F.size(samples) > 0, F.slice(samples, 1, 5)).alias("invalid_samples"),
    ]
    return parsed.withColumn("context", F.to_json(F.struct(*kept, *extra))).drop("_d", "_x")


def exception_evidence(events: DataFrame, details: str = "details", chain: int = 5) -> DataFrame:
    """The exception in ``details`` as a struct: type, category, message, chain, traceback flag."""
    fields = ("exception STRUCT<type STRING, category STRING, message STRING, traceback STRING,"
              " chain ARRAY<STRUCT<type STRING, category STRING, message STRING>>>")
    exc = F.col("_e.exception")
    links = F.transform(F.slice(F.coalesce(exc["chain"], F.array().cast(
        "array<struct<type:string,category:string,message:string>>")), 1, chain),
        lambda c: F.struct(F.coalesce(c["type"], F.lit("")).alias("type"), F.coalesce(c["category"], F.lit("")).alias("category"),
                           redact(c["message"], 500).alias("message")))
    evidence = F.struct(F.coalesce(exc["type"], F.lit("")).alias("type"), F.coalesce(exc["category"], F.lit("")).alias("category"),
                        redact(exc["message"], 1000).alias("message"), links.alias("chain"),
                        (F.coalesce(exc["traceback"], F.lit("")) != "").alias("has_traceback"))
    return events.withColumn("_e", F.from_json(details, fields)).withColumn(
        "exception", F.when(exc.isNotNull(), evidence)).drop("_e")


def compact_repeat(events: DataFrame, details: str = "details") -> DataFrame:
    """What a stored repeat keeps: context, stage, input path and the exception without its chain."""
    rows = exception_evidence(compact_context(events, details), details)
    known = F.from_json(details, "stage STRING, input_path STRING")
    return (rows.withColumn("stage", known["stage"]).withColumn("input_path", known["input_path"])
            .withColumn("exception", F.col("exception").dropFields("chain"))
            .withColumn("sample_kind", F.lit("repeat_checkpoint")))
