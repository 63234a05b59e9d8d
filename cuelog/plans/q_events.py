"""Queries over the problem log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources import writers as wr
from . import views as v
from .registry import register
from .views import with_views

CLOCK = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# message after redaction and normalisation, spelled out for the generated messages
DIAG = r"""SELECT *, sha256(concat_ws(chr(31), event, level, family, sig_message, coalesce(stage, ''), coalesce(service, ''), '',
        lower(coalesce(exc_type, '')), coalesce(exc_category, ''), sig_exc, '', '', ''))[1:20] AS signature FROM (
    SELECT *, CASE WHEN exc_category IS NOT NULL THEN exc_category
            WHEN regexp_matches(event, 'network|timeout|connection|http') THEN 'network'
            WHEN event LIKE '%validation%' AND regexp_matches(event, 'video|media|output') THEN 'media_validation'
            WHEN regexp_matches(event, 'ffmpeg|ffprobe|subprocess|encoder|mux') THEN 'external_process'
            WHEN regexp_matches(event, 'translation|translator') THEN 'translation'
            WHEN regexp_matches(event, 'tts|voice|audio') THEN 'text_to_speech'
            WHEN regexp_matches(event, 'cache|checkpoint|recovery') THEN 'recovery_and_cache'
            WHEN regexp_matches(event, 'file|path|batch|input|output') THEN 'file_pipeline'
            WHEN regexp_matches(event, 'worker|application|app_|session') THEN 'application' ELSE 'runtime' END AS family
    FROM (SELECT * REPLACE (regexp_replace(message, '(https://[^? ]+)\?[^ ]*', '\1?...') AS message),
            level IN ('warning', 'error') AS is_problem,
            CASE WHEN exc_type IS NOT NULL THEN 'network_timeout' END AS exc_category,
            regexp_replace(regexp_replace(lower(message), 'https://[^ ]+', '<url>'), '\b\d+\b', '<n>', 'g') AS sig_message,
            regexp_replace(lower(coalesce(exc_message, '')), '\b\d+\b', '<n>', 'g') AS sig_exc FROM v_ev))"""
OCC = """SELECT *, row_number() OVER (PARTITION BY session_id, signature ORDER BY sequence) AS occurrence FROM diag"""
SAMPLED = "(" + ", ".join(f"'{e}'" for e in ev.SAMPLED_EVENTS) + ")"
STORED = f"""SELECT *, event NOT IN {SAMPLED} OR occurrence <= 3 OR occurrence IN (5, 10, 20, 50, 100) OR occurrence % 250 = 0 AS stored FROM occ"""
CARRY = """SELECT *, coalesce(last_value(CASE WHEN event = 'app_session_finished' THEN 'closed' ELSE stage END IGNORE NULLS) OVER w, 'startup') AS stage_cf,
        last_value(input_path IGNORE NULLS) OVER w AS input_path_cf FROM stored
        WINDOW w AS (PARTITION BY session_id ORDER BY sequence)"""
ROLL = """SELECT session_id, signature, count(*) AS occurrences_total, count(*) FILTER (stored) AS stored_samples,
        min_by(event, sequence) AS event, min_by(level, sequence) AS level, min_by(message, sequence) AS message,
        min_by(family, sequence) AS family, coalesce(min_by(exc_category, sequence), min_by(family, sequence)) AS category,
        min_by(coalesce(stage, stage_cf), sequence) AS stage,
        (array_agg(coalesce(input_path, input_path_cf) ORDER BY sequence))[1] AS input_path,
        min(ts) AS first_ts, max(ts) AS last_ts, min(sequence) AS first_sequence, max(sequence) AS last_sequence
        FROM carry WHERE is_problem GROUP BY session_id, signature"""
RECENT = """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_sequence DESC) AS n FROM roll) WHERE n <= 20"""
CARDS = """SELECT *, CASE WHEN level = 'error' OR regexp_matches(event, '(_failed|_crashed)$') THEN 'high'
            WHEN occurrences_total >= 3 THEN 'medium' ELSE 'low' END AS priority,
        CASE WHEN level = 'error' OR regexp_matches(event, '(_failed|_crashed)$') THEN 'terminal_failure' ELSE 'retry_or_warning' END AS state,
        CASE WHEN event = 'translation_provider_response_rejected' THEN 'translation_provider_response'
             WHEN category IN ('network', 'network_timeout') THEN 'network_retry'
             WHEN category IN ('text_to_speech', 'translation') THEN 'translation_tts'
             WHEN category = 'external_process' THEN 'ffmpeg_process' WHEN category = 'file_pipeline' THEN 'files_paths'
             ELSE 'application_exception' END AS playbook FROM recent"""
RANKED = """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE priority WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END,
            occurrences_total DESC, last_sequence) AS rank, count(*) OVER (PARTITION BY session_id) AS cards FROM cards"""
CHAIN = {"diag": DIAG, "occ": OCC, "stored": STORED, "carry": CARRY, "roll": ROLL, "recent": RECENT, "cards": CARDS, "ranked": RANKED}


def _upto(last: str, body: str, **more: str) -> str:
    steps = {}
    for name, query in CHAIN.items():
        steps[name] = query
        if name == last:
            break
    return with_views(body, "v_ev", **steps, **more)


def _diagnosed(spark, sf):
    return ev.diagnose(v.v_ev(spark, sf))


def _rollup(spark, sf):
    return ev.signature_rollup(_diagnosed(spark, sf))


def _cards(spark, sf):
    return ev.issue_cards(ev.recent_problems(_rollup(spark, sf)))


@register("issue_cards", _upto("ranked", """
    SELECT session_id, rank, signature, priority, state, event, category, occurrences_total, stored_samples, stage, input_path,
        message, first_sequence, last_sequence, playbook, CASE playbook WHEN 'translation_provider_response'
        THEN 'confirmed_invalid_provider_payload' ELSE 'likely_not_proven' END AS cause_status, greatest(0, cards - 10) AS omitted
    FROM ranked WHERE rank <= 10"""))
def _(spark, sf):
    return ev.rank_issue_cards(_cards(spark, sf)).select(
        "session_id", "rank", "signature", "priority", "state", "event", "category", "occurrences_total", "stored_samples",
        "stage", "input_path", "message", "first_sequence", "last_sequence", "playbook", "cause_status", "omitted")


@register("attach_playbooks", _upto("cards", """
    SELECT session_id, signature, playbook, length(playbook) > 0 AS advised FROM cards"""))
def _(spark, sf):
    out = ev.attach_playbooks(_cards(spark, sf), ev.playbook_table(spark))
    return out.select("session_id", "signature", "playbook", (F.length("recommended_fix") > 0).alias("advised"))


@register("problems", with_views("""SELECT session_id, sequence, CASE level WHEN 'error' THEN 'investigate' ELSE 'review' END AS actionability
    FROM v_ev WHERE level IN ('warning', 'error')""", "v_ev"))
def _(spark, sf):
    return ev.problems(v.v_ev(spark, sf)).select("session_id", "sequence", "actionability")


@register("event_signature", _upto("diag", "SELECT session_id, sequence, family, message, signature FROM diag"))
def _(spark, sf):
    return _diagnosed(spark, sf).select("session_id", "sequence", "family", "message", "signature")


@register("number_occurrences", _upto("occ", "SELECT session_id, sequence, signature, occurrence FROM occ"))
def _(spark, sf):
    return ev.number_occurrences(_diagnosed(spark, sf)).select("session_id", "sequence", "signature", "occurrence")


@register("sample_repeats", _upto("stored", "SELECT session_id, sequence, occurrence, stored FROM stored"))
def _(spark, sf):
    return ev.sample_repeats(_diagnosed(spark, sf)).select("session_id", "sequence", "occurrence", "stored")


for _by, _key in {"level": "level", "event": "event", "category": "coalesce(exc_category, family)"}.items():
    @register(f"event_counters_{_by}", _upto("diag", f"SELECT session_id, {_key} AS key, count(*) AS n FROM diag GROUP BY ALL"))
    def _(spark, sf, by=_by):
        return ev.event_counters(_diagnosed(spark, sf), by)


@register("carry_context", _upto("carry", "SELECT session_id, sequence, stage_cf, input_path_cf FROM carry"))
def _(spark, sf):
    return ev.carry_context(v.v_ev(spark, sf)).select("session_id", "sequence", "stage_cf", "input_path_cf")


QUALITY = """SELECT session_id, count(*) AS events_total, count(*) FILTER (is_problem) AS problem_events_total,
        count(*) FILTER (level = 'error') AS error_events_total,
        count(*) FILTER (is_problem AND coalesce(stage, stage_cf) <> '') AS problems_with_stage,
        count(*) FILTER (is_problem AND input_path_cf IS NOT NULL) AS problems_with_input_path,
        count(*) FILTER (is_problem AND input_path_cf IS NULL AND coalesce(stage, stage_cf) = '') AS problems_missing_stage_and_input,
        count(*) FILTER (level = 'error' AND NOT has_traceback) AS errors_without_traceback,
        count(*) FILTER (is_problem AND has_traceback) AS exceptions_with_traceback,
        count(*) FILTER (stored) AS records_stored_total, count(*) FILTER (stored AND is_problem) AS problem_events_stored,
        count(*) FILTER (stored AND NOT is_problem) AS timeline_events_stored, count(*) FILTER (NOT stored) AS repeat_events_compacted,
        count(DISTINCT signature) FILTER (is_problem) AS unique_problem_signatures_total,
        coalesce(sum(length('{"session_id":' || session_id || ',"sequence":' || sequence || ',"level":"' || level || '","event":"' || event
            || '","message":"' || message || '","signature":"' || signature || '"}')) FILTER (NOT stored), 0) AS estimated_bytes_saved,
        any_value(coalesce(g.n, 0)) AS problem_signatures_outside_recent_window
        FROM carry LEFT JOIN gone g USING (session_id) GROUP BY session_id"""

def _gone(others: int) -> str:
    """Problems that come back after so many others, counted pair by pair: others whose next sighting is not before the return."""
    return f"""SELECT session_id, count(*) AS n FROM (
        SELECT a.session_id, a.sequence FROM p a JOIN p b ON b.session_id = a.session_id AND b.sequence > a.before AND b.sequence < a.sequence
        AND (b.after IS NULL OR b.after > a.sequence) GROUP BY ALL HAVING count(*) >= {others}) GROUP BY session_id"""


SIGHTINGS = """SELECT session_id, sequence, lag(sequence) OVER w AS before, lead(sequence) OVER w AS after FROM carry WHERE is_problem WINDOW w AS (PARTITION BY session_id, signature ORDER BY sequence)"""


@register("diagnostics_quality", _upto("carry", QUALITY, p=SIGHTINGS, gone=_gone(20)))
def _(spark, sf):
    return ev.diagnostics_quality(_diagnosed(spark, sf))


@register("problems_outside_window", _upto("carry", """SELECT session_id, coalesce(g.n, 0) AS problem_signatures_outside_recent_window
    FROM (SELECT DISTINCT session_id FROM carry) LEFT JOIN gone g USING (session_id)""", p=SIGHTINGS, gone=_gone(5)))
def _(spark, sf):
    """The same count for a list of five, which the sessions of the table overflow."""
    return ev.diagnostics_quality(_diagnosed(spark, sf), recent=5).select("session_id", "problem_signatures_outside_recent_window")


@register("signature_rollup", _upto("roll", """SELECT session_id, signature, occurrences_total, stored_samples, event, level, message,
    category, stage, input_path, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, first_sequence, last_sequence FROM roll"""))
def _(spark, sf):
    return _rollup(spark, sf).select(
        "session_id", "signature", "occurrences_total", "stored_samples", "event", "level", "message", "category", "stage",
        "input_path", F.date_format("first_ts", CLOCK).alias("first_seen"), F.date_format("last_ts", CLOCK).alias("last_seen"),
        "first_sequence", "last_sequence")


@register("recent_problems", _upto("recent", "SELECT session_id, signature, last_sequence FROM recent"))
def _(spark, sf):
    return ev.recent_problems(_rollup(spark, sf)).select("session_id", "signature", "last_sequence")


@register("top_events", with_views("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, event) AS rank
    FROM (SELECT session_id, event, count(*) AS n FROM v_ev GROUP BY ALL)) WHERE rank <= 12""", "v_ev"))
def _(spark, sf):
    return ev.top_events(v.v_ev(spark, sf))


@register("pair_incidents", with_views("""
    SELECT s.session_id, service, sequence, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started, CASE WHEN nxt = 'network_storm_finished' THEN strftime(nts, '%Y-%m-%d %H:%M:%S.%f') END AS finished,
        round(CASE WHEN nxt = 'network_storm_finished' THEN (epoch_us(nts) - epoch_us(ts)) / 1e6 END, 3) AS duration_sec,
        CASE WHEN nxt = 'network_storm_finished' THEN 'finished' WHEN closed > sequence THEN 'unresolved' ELSE 'open' END AS state
    FROM (SELECT *, lead(event) OVER w AS nxt, lead(ts) OVER w AS nts FROM v_ev WHERE event LIKE 'network_storm_%'
          WINDOW w AS (PARTITION BY session_id, service ORDER BY sequence)) s
    LEFT JOIN (SELECT session_id, max(sequence) AS closed FROM v_ev WHERE event = 'app_session_finished' GROUP BY 1) USING (session_id)
    WHERE event = 'network_storm_started'""", "v_ev"))
def _(spark, sf):
    return ev.pair_incidents(v.v_ev(spark, sf)).select(
        "session_id", "service", "sequence", F.date_format("started_at", CLOCK).alias("started"),
        F.date_format("finished_at", CLOCK).alias("finished"), "duration_sec", "state")


SESSIONS = """SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'closed' ELSE 'running' END AS status,
        CASE WHEN session_id % 7 = 0 THEN NULL ELSE max(ts) END AS updated FROM v_ev GROUP BY session_id"""


@register("session_status", with_views("""
    SELECT session_id, CASE WHEN updated IS NOT NULL THEN greatest(0, CAST(epoch(TIMESTAMP '2024-01-30 23:00:00') AS BIGINT) - CAST(floor(epoch(updated)) AS BIGINT)) END AS age_sec,
        CASE WHEN status <> 'running' THEN status WHEN updated IS NULL OR
            CAST(epoch(TIMESTAMP '2024-01-30 23:00:00') AS BIGINT) - CAST(floor(epoch(updated)) AS BIGINT) >= 7200 THEN 'interrupted' ELSE 'possibly_active' END AS status
    FROM sessions""", "v_ev", sessions=SESSIONS))
def _(spark, sf):
    sessions = v.v_ev(spark, sf).groupBy("session_id").agg(F.max("ts").alias("t")).select(
        "session_id", F.expr("CASE WHEN session_id % 4 = 0 THEN 'closed' ELSE 'running' END").alias("status"),
        F.expr("CASE WHEN session_id % 7 = 0 THEN 'unknown' ELSE cast(t AS string) END").alias("updated_at"))
    return ev.session_status(sessions, F.lit("2024-01-30 23:00:00").cast("timestamp"), 7200).select("session_id", "age_sec", "status")


@register("stage_durations", with_views("""
    SELECT stage, count(elapsed_sec) AS n, round(avg(elapsed_sec), 3) AS avg_sec, quantile_cont(elapsed_sec, 0.5) AS p50_sec,
        max(elapsed_sec) AS max_sec FROM v_ev WHERE event = 'stage_finished' GROUP BY stage""", "v_ev"))
def _(spark, sf):
    return ev.stage_durations(v.v_ev(spark, sf)).withColumn("avg_sec", F.round("avg_sec", 3))


@register("union_logs", with_views("""SELECT session_id, sequence, level FROM v_ev""", "v_ev"))
def _(spark, sf):
    log = v.v_ev(spark, sf)
    bad = F.col("level").isin("warning", "error")
    return ev.union_logs(log.filter(~bad), log.filter(bad)).select("session_id", "sequence", "level")


RULES = {"network": ["network", "network_timeout"], "files": ["file_pipeline", "file_access"], "cache": ["recovery_and_cache"]}
FIRED = """SELECT session_id, concat_ws(',', CASE WHEN bool_or(category IN ('network', 'network_timeout')) THEN 'network' END,
        CASE WHEN bool_or(category IN ('file_pipeline', 'file_access')) THEN 'files' END) AS fired
        FROM (SELECT session_id, CASE WHEN is_problem THEN coalesce(exc_category, family) END AS category FROM diag) GROUP BY session_id"""


@register("rules_fired", _upto("diag", FIRED))
def _(spark, sf):
    return ev.session_counters(_diagnosed(spark, sf)).select(
        "session_id", F.array_join(ev.rules_fired(F.col("categories"), RULES), ",").alias("fired"))


@register("session_verdict", _upto("carry", """
    SELECT session_id, CASE WHEN e > 0 THEN 'errors_detected' WHEN w > 0 THEN 'warnings_detected' ELSE 'no_problems_detected_yet' END AS result,
        CASE WHEN e + w + rep = 0 THEN 'nothing_recorded' ELSE concat_ws(',', CASE WHEN e > 0 THEN 'errors' END, CASE WHEN w > 0 THEN 'warnings' END, CASE WHEN rep > 0 THEN 'repeats' END) END AS observations,
        CASE WHEN NOT (resp OR net OR ext OR fil OR (app AND e > 0)) THEN 'low:no_confirmed_change' ELSE concat_ws(',', CASE WHEN resp THEN 'high:translation_response_validation' END,
            CASE WHEN net THEN CASE WHEN e > 0 THEN 'high' ELSE 'medium' END || ':network_and_tts' END, CASE WHEN ext THEN 'high:ffmpeg_pipeline' END,
            CASE WHEN fil THEN CASE WHEN e > 0 THEN 'high' ELSE 'medium' END || ':files_and_paths' END, CASE WHEN app AND e > 0 THEN 'high:application_code' END) END AS candidates,
        CASE WHEN no_trace > 0 THEN 'high:errors_without_traceback' ELSE 'low:no_gap_found' END AS logging_gaps
    FROM (SELECT session_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w,
            count(*) FILTER (is_problem) - count(DISTINCT signature) FILTER (is_problem) AS rep,
            count(*) FILTER (level = 'error' AND NOT has_traceback) AS no_trace,
            coalesce(bool_or(event = 'translation_provider_response_rejected') FILTER (is_problem), false) AS resp,
            coalesce(bool_or(coalesce(exc_category, family) IN ('network', 'network_timeout', 'text_to_speech')) FILTER (is_problem), false) AS net,
            coalesce(bool_or(coalesce(exc_category, family) = 'external_process') FILTER (is_problem), false) AS ext,
            coalesce(bool_or(coalesce(exc_category, family) = 'file_pipeline') FILTER (is_problem), false) AS fil,
            coalesce(bool_or(coalesce(exc_category, family) IN ('application', 'runtime')) FILTER (is_problem), false) AS app
          FROM carry GROUP BY session_id)"""))
def _(spark, sf):
    events = _diagnosed(spark, sf)
    out = ev.session_verdict(ev.session_counters(events), ev.diagnostics_quality(events))
    return out.select("session_id", "result", *[F.array_join(c, ",").alias(c) for c in ("observations", "candidates", "logging_gaps")])


#: Sessions of seven installations in the order of their first event, and how the one before each ended.
PREVIOUS = """SELECT session_id, CASE WHEN shut THEN 'closed' WHEN age >= 900000000 THEN 'interrupted' WHEN age IS NOT NULL THEN 'possibly_active' END AS previous_status FROM (
    SELECT session_id, lag(closed) OVER w AS shut, epoch_us(a) - epoch_us(lag(b) OVER w) AS age FROM (
        SELECT session_id, min(ts) AS a, min(ts) + INTERVAL '5 hours' AS b, bool_or(event = 'app_session_finished' AND sequence % 3 = 0) AS closed FROM v_ev GROUP BY session_id)
    WINDOW w AS (PARTITION BY session_id % 7 ORDER BY a, session_id))"""


def _previous(spark, sf):
    shut = F.coalesce(F.bool_or((F.col("event") == "app_session_finished") & (F.col("sequence") % 3 == 0)), F.lit(False))
    sessions = v.v_ev(spark, sf).groupBy("session_id").agg(F.min("ts").alias("started"), shut.alias("closed"))
    sessions = sessions.withColumn("last_seen", F.col("started") + F.expr("INTERVAL '5' HOUR")).withColumn("installation", F.col("session_id") % 7)
    return ev.previous_status(sessions)


@register("previous_status", with_views(PREVIOUS, "v_ev"))
def _(spark, sf):
    return _previous(spark, sf)


@register("session_verdict_full", _upto("ranked", f"""
    SELECT c.session_id, coalesce(s.signature, '') AS primary_issue_signature, concat_ws(',', CASE WHEN e > 0 THEN 'errors' END, CASE WHEN w > 0 THEN 'warnings' END, CASE WHEN rep > 0 THEN 'repeats' END,
            CASE WHEN p.previous_status = 'interrupted' THEN 'previous_session_interrupted' END, CASE WHEN c.session_id % 3 > 0 THEN 'fallback_voice' END,
            CASE WHEN c.session_id % 10 / 100e0 >= 0.05 THEN 'pauses' END) AS observations,
        concat_ws(',', CASE WHEN resp THEN 'high:translation_response_validation' END, CASE WHEN c.session_id % 10 / 100e0 >= 0.05 THEN 'medium:pause_sync_quality' END,
            CASE WHEN c.session_id % 3 > 0 THEN 'medium:tts_voice_consistency' END, CASE WHEN net THEN CASE WHEN e > 0 THEN 'high' ELSE 'medium' END || ':network_and_tts' END, CASE WHEN ext THEN 'high:ffmpeg_pipeline' END,
            CASE WHEN fil THEN CASE WHEN e > 0 THEN 'high' ELSE 'medium' END || ':files_and_paths' END, CASE WHEN p.previous_status = 'interrupted' THEN 'medium:recovery' END, CASE WHEN app AND e > 0 THEN 'high:application_code' END) AS candidates,
        CASE WHEN no_trace + (c.session_id % 4 = 0)::INT = 0 THEN 'low:no_gap_found' ELSE concat_ws(',', CASE WHEN no_trace > 0 THEN 'high:errors_without_traceback' END, CASE WHEN c.session_id % 4 = 0 THEN 'high:artifact_write_errors' END) END AS logging_gaps
    FROM (SELECT session_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w,
            count(*) FILTER (is_problem) - count(DISTINCT signature) FILTER (is_problem) AS rep,
            count(*) FILTER (level = 'error' AND NOT has_traceback) AS no_trace,
            coalesce(bool_or(event = 'translation_provider_response_rejected') FILTER (is_problem), false) AS resp,
            coalesce(bool_or(coalesce(exc_category, family) IN ('network', 'network_timeout', 'text_to_speech')) FILTER (is_problem), false) AS net,
            coalesce(bool_or(coalesce(exc_category, family) = 'external_process') FILTER (is_problem), false) AS ext,
            coalesce(bool_or(coalesce(exc_category, family) = 'file_pipeline') FILTER (is_problem), false) AS fil,
            coalesce(bool_or(coalesce(exc_category, family) IN ('application', 'runtime')) FILTER (is_problem), false) AS app
          FROM carry GROUP BY session_id) c JOIN ({PREVIOUS}) p ON p.session_id = c.session_id LEFT JOIN (SELECT session_id, signature FROM ranked WHERE rank = 1) s ON s.session_id = c.session_id
    WHERE e + w > 0"""))
def _(spark, sf):
    """Every rule of the verdict, with pauses, voices and artifacts made from the session's number; sessions with errors or warnings."""
    events = _diagnosed(spark, sf)
    pause = _previous(spark, sf).withColumns({
        "pause_ratio": F.col("session_id") % 10 / 100.0, "fallback_segments": F.col("session_id") % 3, "artifact_errors": (F.col("session_id") % 4 == 0).cast("int")})
    cards = ev.rank_issue_cards(_cards(spark, sf))
    out = ev.session_verdict(ev.session_counters(events), ev.diagnostics_quality(events), pause, cards).filter("result <> 'no_problems_detected_yet'")
    return out.select("session_id", "primary_issue_signature", *[F.array_join(c, ",").alias(c) for c in ("observations", "candidates", "logging_gaps")])


@register("session_report", _upto("ranked", r"""
    SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS issues, string_agg(event || ' x' || occurrences_total, ',' ORDER BY rank) AS told FROM ranked WHERE rank <= 10 GROUP BY session_id"""))
def _(spark, sf):
    """The Markdown reports, read back: what the table of issues of each says."""
    events = _diagnosed(spark, sf)
    verdict = ev.session_verdict(ev.session_counters(events), ev.diagnostics_quality(events))
    reports = wr.to_session_report(verdict, ev.rank_issue_cards(_cards(spark, sf)), ev.top_events(v.v_ev(spark, sf)))
    rows = F.regexp_extract_all("document", F.lit(r"\n\| (\d+ \| [^|]+ \| [^|]+ \| \d+) \|"), F.lit(1))
    told = F.transform(rows, lambda r: F.concat(F.trim(F.split(r, r"\|")[2]), F.lit(" x"), F.trim(F.split(r, r"\|")[3])))
    out = reports.select(F.regexp_extract("document", r"^# Session (\S+)", 1).alias("session_id"), told.alias("t")).filter(F.size("t") > 0)
    return out.select("session_id", F.size("t").cast("bigint").alias("issues"), F.array_join("t", ",").alias("told"))


def _with_details(spark, sf):
    """Events with a free-form JSON text built from their columns."""
    rows = v.v_ev(spark, sf)
    exc = F.when(F.col("exc_type").isNotNull(), F.struct(F.col("exc_type").alias("type"), F.col("exc_message").alias("message"),
                                                        F.when(F.col("has_traceback"), "File x").alias("traceback")))
    return rows.withColumn("details", F.to_json(F.struct(
        "service", "stage", "input_path", "elapsed_sec", F.lit("").alias("provider"),
        F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i.cast("string")).alias("command"), exc.alias("exception"),
        F.lit("secret").alias("api_key"), F.concat(F.lit("https://h/?t="), F.col("sequence").cast("string")).alias("endpoint"))))


@register("compact_context", with_views("""SELECT session_id, sequence, service, elapsed_sec AS elapsed, NULL AS provider, 16 AS command_shown,
    20 AS command_total, NULL AS api_key FROM v_ev""", "v_ev"))
def _(spark, sf):
    out = ev.compact_context(_with_details(spark, sf))
    return out.select("session_id", "sequence", F.get_json_object("context", "$.service").alias("service"),
                      F.get_json_object("context", "$.elapsed_sec").cast("double").alias("elapsed"),
                      F.get_json_object("context", "$.provider").alias("provider"),
                      F.size(F.from_json(F.get_json_object("context", "$.command_preview"), "array<string>")).alias("command_shown"),
                      F.get_json_object("context", "$.command_items_total").cast("int").alias("command_total"),
                      F.get_json_object("context", "$.api_key").alias("api_key"))


@register("exception_evidence", with_views("""SELECT session_id, sequence, exc_type, exc_message,
    CASE WHEN exc_type IS NOT NULL THEN has_traceback END AS has_traceback FROM v_ev""", "v_ev"))
def _(spark, sf):
    return ev.exception_evidence(_with_details(spark, sf)).select(
        "session_id", "sequence", F.col("exception.type").alias("exc_type"), F.col("exception.message").alias("exc_message"),
        F.col("exception.has_traceback").alias("has_traceback"))


@register("compact_repeat")
def _(spark, sf):
    return ev.compact_repeat(_with_details(spark, sf)).select(
        "session_id", "sequence", "context", "stage", "input_path", F.to_json("exception").alias("exception"), "sample_kind")
