"""Queries for the streaming operators: batch twins, and streams run over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources import writers as wr
from ..streaming import live as lv
from ..streaming import machines as mc
from ..streaming import storms as sm
from . import views as v
from .q_inventory import _fresh
from .q_events import _upto
from .registry import register
from .views import with_views

SECONDS = "cast(timestampdiff(SECOND, timestamp'2024-01-01 00:00:00', ts) AS double)"


def _event_stream(spark, sf):
    """The events table read as a stream of files; the table is one file or a folder of them."""
    schema = v.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/events.parquet*")


def _requests(rows):
    """The same view as ``v_req``, of the events as they come."""
    return rows.select(
        (F.col("user_id") % 5).alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.expr("CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'request' END").alias("kind"),
        F.expr("CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'rate_limit' ELSE 'timeout' END END").alias("reason"))


CIRCUIT = """SELECT *, row_number() OVER w AS p, coalesce(lag(r) OVER w, '') AS prev FROM (
        SELECT service AS provider, CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) AS DOUBLE) AS t, seq, reason, coalesce(reason, '') AS r
        FROM v_req WHERE kind <> 'request') WINDOW w AS (PARTITION BY provider ORDER BY t, seq)"""


CIRCUITS = with_views("""
    SELECT provider, seq, streak, round(coalesce(until, 0), 3) AS cooldown_until, coalesce(lag(until) OVER (PARTITION BY provider ORDER BY t, seq), 0) <= t AS available
    FROM (SELECT *, max(u) OVER (PARTITION BY provider, epoch ORDER BY t, seq) AS until FROM (
        SELECT *, CASE WHEN r = '' THEN NULL ELSE t + CASE WHEN r = 'rate_limit' THEN least(3600e0 * power(2e0, least(streak - 1, 4)), 900e0) ELSE 3600e0 END END AS u
        FROM (SELECT *, CASE WHEN r = '' THEN 0 ELSE p - max(CASE WHEN r = '' OR r <> prev THEN p END) OVER w + 1 END AS streak,
                coalesce(max(CASE WHEN r = '' THEN p END) OVER w, 0) AS epoch FROM c WINDOW w AS (PARTITION BY provider ORDER BY t, seq))))""", "v_req", c=CIRCUIT)


@register("provider_circuit_stream", CIRCUITS)
def _(spark, sf):
    calls = _requests(_event_stream(spark, sf)).filter("kind <> 'request'").select(F.col("service").alias("provider"), F.expr(SECONDS).alias("ts"), "seq", "reason")
    out = lv.drain(mc.provider_circuit_stream(calls, 3600.0))
    return out.select(F.col("provider").cast("bigint").alias("provider"), "seq", "streak", F.round("cooldown_until", 3).alias("cooldown_until"), "available")


@register("provider_circuit", CIRCUITS)
def _(spark, sf):
    calls = v.v_req(spark, sf).filter("kind <> 'request'").select(
        F.col("service").alias("provider"), F.expr(SECONDS).alias("ts"), "seq", "reason")
    return mc.provider_circuit(calls, 3600.0).select("provider", "seq", "streak", F.round("cooldown_until", 3).alias("cooldown_until"), "available")


@register("detect_stalls", with_views("""
    SELECT session_id, sequence, round((epoch_us(nts) - epoch_us(ts)) / 1e6, 3) AS gap_sec FROM (
        SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY sequence) AS nts FROM v_ev) WHERE epoch_us(nts) - epoch_us(ts) >= 36000000000""", "v_ev"))
def _(spark, sf):
    events = v.v_ev(spark, sf)
    stalls = mc.detect_stalls(events, 36000)
    return stalls.join(events.select("session_id", F.col("ts").alias("last_seen"), "sequence"), ["session_id", "last_seen"]).select(
        "session_id", "sequence", F.round("gap_sec", 3).alias("gap_sec"))


@register("windowed_failures", with_views("""
    SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, service, count(*) AS failures
    FROM v_req WHERE kind = 'failure' GROUP BY ALL""", "v_req"))
def _(spark, sf):
    out = lv.windowed_failures(v.v_req(spark, sf), "6 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "service", "failures")


@register("windowed_failures_stream", with_views("""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, service, failures FROM (
        SELECT time_bucket(INTERVAL '6 hours', ts) AS w, service, count(*) AS failures FROM v_req WHERE kind = 'failure' GROUP BY ALL)
    WHERE w + INTERVAL '6 hours' <= (SELECT max(ts) FROM v_req WHERE kind = 'failure') - INTERVAL '1 hour'""", "v_req"))
def _(spark, sf):
    """Windows that the watermark has closed."""
    out = lv.drain(lv.windowed_failures(_requests(_event_stream(spark, sf)), "6 hours", "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "service", "failures")


#: A stretch begins where the failure before is the gap away.
STRETCHES = """SELECT service, min(ts) AS a, max(ts) + INTERVAL '2 hours' AS b, count(*) AS failures FROM (
        SELECT *, sum(CASE WHEN ts < prev + INTERVAL '2 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY ts, seq) AS g FROM (
            SELECT *, lag(ts) OVER (PARTITION BY service ORDER BY ts, seq) AS prev FROM v_req WHERE kind = 'failure')) GROUP BY service, g"""
STRETCH_COLUMNS = "SELECT strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS session_end, service, failures FROM stretches"


def _stretches(out):
    clock = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select(F.date_format("session_start", clock).alias("session_start"), F.date_format("session_end", clock).alias("session_end"), "service", "failures")


@register("failure_sessions", with_views(STRETCH_COLUMNS, "v_req", stretches=STRETCHES))
def _(spark, sf):
    return _stretches(lv.failure_sessions(v.v_req(spark, sf), "2 hours"))


@register("failure_sessions_stream", with_views(STRETCH_COLUMNS + " WHERE b <= (SELECT max(ts) FROM v_req WHERE kind = 'failure') - INTERVAL '1 hour'", "v_req", stretches=STRETCHES))
def _(spark, sf):
    """Stretches that the watermark has closed."""
    return _stretches(lv.drain(lv.failure_sessions(_requests(_event_stream(spark, sf)), "2 hours", "1 hour")))


LIVE = with_views("""
    SELECT session_id, count(*) AS events, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
        max_by(event, sequence) AS last_event, max(sequence) AS last_sequence,
        coalesce(max_by(CASE WHEN event = 'app_session_finished' THEN 'closed' ELSE stage END, sequence) FILTER (event = 'app_session_finished' OR stage IS NOT NULL), 'startup') AS stage,
        max_by(input_path, sequence) FILTER (input_path IS NOT NULL) AS input_path, count(*) FILTER (event = 'network_storm_started') AS incidents_started,
        count(*) FILTER (event = 'network_storm_finished') AS incidents_finished, bool_or(event = 'app_session_finished') AS closed FROM v_ev GROUP BY session_id""", "v_ev")


@register("live_summary_stream", LIVE)
def _(spark, sf):
    return lv.drain_latest(lv.live_summary(v.ev_from(_event_stream(spark, sf))), ["session_id"])


@register("live_summary", LIVE)
def _(spark, sf):
    return lv.live_summary(v.v_ev(spark, sf))


VOICE = """SELECT session_id, sequence, service, 'voice ' || (sequence % 3) AS voice, CASE WHEN sequence % 2 = 0 THEN 1 ELSE 0 END AS fallback_count,
        CASE event WHEN 'network_storm_started' THEN 'tts_voice_preservation_started' WHEN 'tts_retry' THEN 'tts_edge_probe_started'
            WHEN 'tts_segment_failed' THEN 'tts_gtts_fallback_enabled' WHEN 'stage_finished' THEN 'tts_summary' ELSE event END AS event FROM v_ev"""


VOICES = with_views("""
    SELECT session_id, coalesce(max_by(st, sequence) FILTER (st IS NOT NULL), 'idle') AS status, coalesce(max_by(fb, sequence) FILTER (fb IS NOT NULL), '') AS fallback_provider,
        coalesce(max_by(vo, sequence) FILTER (vo IS NOT NULL), '') AS selected_voice, coalesce(max_by(fb, sequence) FILTER (fb IS NOT NULL), '') <> '' AS voice_may_differ
    FROM (SELECT *, CASE WHEN event = 'tts_voice_preservation_started' THEN 'waiting_for_edge_tts' WHEN event = 'tts_edge_probe_started' THEN 'checking_edge_tts'
            WHEN event = 'network_storm_finished' AND service = 'edge_tts' THEN 'selected_voice_restored' WHEN event = 'tts_gtts_fallback_enabled' THEN 'gtts_fallback'
            WHEN event = 'tts_summary' THEN 'finished' END AS st,
        CASE WHEN event = 'tts_voice_preservation_started' THEN '' WHEN event = 'tts_gtts_fallback_enabled' THEN 'gtts'
            WHEN event = 'tts_summary' THEN CASE WHEN fallback_count > 0 THEN 'gtts' ELSE '' END END AS fb,
        CASE WHEN event IN ('tts_voice_preservation_started', 'tts_gtts_fallback_enabled', 'tts_summary') THEN voice END AS vo FROM voice) GROUP BY session_id""", "v_ev", voice=VOICE)


def _voices(ev_rows):
    names = {"network_storm_started": "tts_voice_preservation_started", "tts_retry": "tts_edge_probe_started",
             "tts_segment_failed": "tts_gtts_fallback_enabled", "stage_finished": "tts_summary"}
    event = F.col("event")
    for old, new in names.items():
        event = F.when(F.col("event") == old, new).otherwise(event)
    rows = ev_rows.select(
        "session_id", "sequence", "service", F.expr("concat('voice ', sequence % 3)").alias("voice"),
        F.expr("CASE WHEN sequence % 2 = 0 THEN 1 ELSE 0 END").alias("fallback_count"),
        F.lit(None).cast("string").alias("voice_consistency"), event.alias("event"))
    return rows


@register("voice_status", VOICES)
def _(spark, sf):
    return lv.voice_status(_voices(v.v_ev(spark, sf)))


@register("voice_status_stream", VOICES)
def _(spark, sf):
    return lv.drain_latest(lv.voice_status(_voices(v.ev_from(_event_stream(spark, sf)))), ["session_id"])


#: One row an answer or request and service, told by the one before: what is known, then what is said of the row.
STORM_CALLS = """SELECT CAST(service AS VARCHAR) AS service, epoch_us(ts) / 1e6 AS t, seq, kind, row_number() OVER (PARTITION BY service ORDER BY ts, seq) AS p FROM v_req"""

STORM_STATES = """SELECT service, 0::BIGINT AS p, NULL::DOUBLE AS t, NULL::BIGINT AS seq, []::DOUBLE[] AS fails, false AS act, 0 AS outages, 0e0 AS until, 0e0 AS began, 0 AS rounds, 0 AS held,
            0 AS streak, 0e0 AS since, false AS asked, NULL::VARCHAR AS event, NULL::VARCHAR AS claim, NULL::DOUBLE AS pause_sec, NULL::DOUBLE AS duration_sec, NULL::INT AS suppressed, NULL::INT AS told
        FROM (SELECT DISTINCT service FROM c)
        UNION ALL
        SELECT service, p, t, seq, CASE WHEN fin THEN [] ELSE fails END, (act OR starts) AND NOT fin, outages + starts::INT,
            CASE WHEN starts THEN t + least(60, 30 + outages * 15) WHEN extends THEN t + least(60, 30 + rounds * 15) ELSE until END,
            CASE WHEN starts THEN t ELSE began END, CASE WHEN starts THEN 1 WHEN fin THEN 0 ELSE rounds + extends::INT END, CASE WHEN starts OR fin THEN 0 WHEN act AND kind = 'failure' THEN held + 1 ELSE held END,
            CASE WHEN good AND NOT fin THEN streak + 1 WHEN fin OR starts OR kind = 'failure' THEN 0 ELSE streak END, CASE WHEN good AND streak = 0 THEN t ELSE since END,
            CASE WHEN kind = 'request' THEN asked OR (act AND t >= until) ELSE false END,
            CASE WHEN starts THEN 'started' WHEN extends THEN 'extended' WHEN fin THEN 'finished' WHEN kind = 'request' THEN 'request' END,
            CASE WHEN kind = 'request' THEN CASE WHEN NOT act THEN 'normal' WHEN t < until OR asked THEN 'bypass' ELSE 'probe' END END,
            CASE WHEN starts THEN least(60, 30 + outages * 15) WHEN extends THEN least(60, 30 + rounds * 15) END,
            CASE WHEN fin THEN round(t - began, 3) END, CASE WHEN fin THEN held END, CASE WHEN starts THEN 1 WHEN extends THEN rounds + 1 WHEN fin THEN rounds END
        FROM (SELECT *, NOT act AND kind = 'failure' AND len(fails) >= 6 AS starts, act AND kind = 'failure' AND t >= until AS extends,
                act AND kind = 'success' AND t >= until AS good, act AND kind = 'success' AND t >= until AND streak + 1 >= 3 AND t - CASE WHEN streak = 0 THEN t ELSE since END >= 10 AS fin
            FROM (SELECT s.* EXCLUDE (p, t, seq, fails, event, claim, pause_sec, duration_sec, suppressed, told), c.p, c.t, c.seq, c.kind,
                    list_filter(CASE WHEN c.kind = 'failure' THEN list_append(s.fails, c.t) ELSE s.fails END, lambda f: c.kind = 'request' OR f >= c.t - 21600) AS fails
                FROM s JOIN c ON c.service = s.service AND c.p = s.p + 1))"""

STORMS = with_views("""
    SELECT service, seq, event, claim, pause_sec, duration_sec, suppressed, told AS rounds FROM s WHERE event IS NOT NULL""", "v_req", c=STORM_CALLS, s=STORM_STATES)


def _calls(rows):
    kind = F.expr("CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'request' END")
    return rows.select((F.col("user_id") % 5).alias("service"), F.expr("unix_micros(cast(ts AS timestamp)) / 1e6").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))


STORM_COLUMNS = ("service", "seq", "event", "claim", "pause_sec", "duration_sec", "suppressed", "rounds")


@register("detect_storms", STORMS)
def _(spark, sf):
    out = lv.drain(mc.detect_storms(_calls(_event_stream(spark, sf)), window_sec=21600, recovery_min=10))
    return out.select(*STORM_COLUMNS)


@register("detect_storms_batch", STORMS)
def _(spark, sf):
    return sm.detect_storms_batch(_calls(v.table(spark, sf, "events")), window_sec=21600, recovery_min=10).select(*STORM_COLUMNS)


@register("sample_repeats_stream", _upto("stored", "SELECT CAST(session_id AS VARCHAR) AS session_id, sequence, signature, occurrence, stored FROM stored"))
def _(spark, sf):
    # the same view as the batch query, over the table read as a stream
    stream = _event_stream(spark, sf)
    events = ev.diagnose(v.ev_from(stream))
    return lv.drain(mc.sample_repeats_stream(events))


@register("log_intake_restart", with_views("""
    SELECT CAST(session_id AS VARCHAR) AS session_id, sequence, level, event, stage, service FROM v_ev""", "v_ev"))
def _(spark, sf):
    """Rotated logs taken in by two runs, files arriving in between: the second goes on where the first stopped."""
    logs, base = _fresh(spark, "rotated"), _fresh(spark, "intake")
    events = v.v_ev(spark, sf)
    wr.write_event_log(events.filter("sequence % 2 = 0"), logs)
    lv.intake(spark, logs, base)
    wr.write_event_log(events.filter("sequence % 2 = 1"), logs)
    return lv.intake(spark, logs, base).select("session_id", "sequence", "level", "event", "stage", "service")
