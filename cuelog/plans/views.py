"""Operator inputs derived from the given tables, in Spark and as SQL text.

Times are multiples of 1/8 s, so double arithmetic is exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_tables: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _tables:
        _tables[key] = spark.read.parquet(key[1])
    return _tables[key]


# ---------------------------------------------------------------- segments
def v_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as timed segments, one turn every two seconds or so."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), "text", "role",
        F.expr("turn * 2D + 0.125D * ((conv_id * 7 + turn * 13) % 8)").alias("start"),
        F.expr("turn * 2D + 0.125D * ((conv_id * 7 + turn * 13) % 8) + 0.125D * (4 + length(text) % 12)").alias("end"))


def v_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_seg(spark, sf_dir).groupBy("media_id").agg(
        (F.max("end") + 0.5).alias("video_dur")).withColumn(
        "fps", F.when(F.col("media_id") % 2 == 0, 25.0).otherwise(30.0))


def v_tts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a measured speech duration (NULL where synthesis failed)."""
    return v_seg(spark, sf_dir).withColumn(
        "tts_dur", F.expr("CASE WHEN (media_id + ord) % 17 <> 0 THEN 0.125D * (3 + length(text) % 40) END")).withColumn(
        "provider", F.expr("element_at(array('edge_tts', 'gtts', 'piper'), cast(ord % 3 as int) + 1)"))


def v_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with recogniser statistics; every fifth media repeats itself."""
    return v_seg(spark, sf_dir).select(
        "media_id", "ord", "start", "end",
        F.expr("CASE WHEN media_id % 5 = 0 THEN concat('Phrase, no. ', floor(ord / 3)) ELSE text END").alias("text"),
        F.expr("-0.125D * (ord % 12)").alias("avg_logprob"),
        F.expr("1 + 0.125D * (length(text) % 16)").alias("compression_ratio"),
        F.expr("0.125D * (ord % 8)").alias("no_speech_prob"),
        F.expr("0.125D * (media_id % 8)").alias("temperature"),
        F.expr("CASE WHEN ord % 4 <> 0 THEN array(named_struct('start', start, 'end', end, 'word', text)) END").alias("words"))


# ---------------------------------------------------------------- pairs and responses
ERROR_PAGE = "<html><head><title>Error</title></head><body>502 Bad Gateway</body></html>"


def v_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source/translation pairs, some damaged."""
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = table(spark, sf_dir, "documents").join(urls, "doc_id", "left")
    source = F.expr("CASE WHEN url IS NULL THEN text ELSE concat(text, ' ', url) END")
    return docs.select(
        F.col("doc_id").alias("pair_id"), F.col("source").alias("media_id"), source.alias("source"),
        F.expr(f"""CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 0 THEN translate(text, '3', '4')
                   WHEN doc_id % 13 = 0 THEN '{ERROR_PAGE}' WHEN doc_id % 7 = 0 THEN 'ok'
                   WHEN doc_id % 4 = 0 THEN lower(concat(text, ' ', coalesce(url, '')))
                   ELSE concat(text, ' ', coalesce(url, '')) END""").alias("translated"),
        F.col("lang").alias("source_lang"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'ru' ELSE lang END").alias("target_lang"))


def v_resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as provider responses, some replaced by error pages."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("""CASE doc_id % 9 WHEN 0 THEN 'Error 503 Service Unavailable'
                  WHEN 1 THEN concat(text, ' please solve the captcha')
                  WHEN 2 THEN '<html><title>500</title> Server error </html>'
                  WHEN 3 THEN '500 There was an error. Please try again later. Server error'
                  WHEN 4 THEN '   ' WHEN 5 THEN concat('<body>', text) ELSE text END""").alias("text"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN concat(text, ' about a server error') ELSE text END").alias("source"))


def v_ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint entries for what the assistant said, some holding an error page."""
    from ..functions.keys import segment_key
    return v_seg(spark, sf_dir).filter("role <> 'user'").select(
        "media_id", segment_key("start", "end", "text").alias("key"),
        F.expr("""CASE WHEN (media_id + ord) % 7 = 0 THEN 'Error 503 Service Unavailable'
                  ELSE lower(text) END""").alias("translated"),
        F.lit(0).alias("ord"))


def v_gloss(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """The lower-case words that the benchmark texts have ``n`` times or more, mapped to upper case."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(text, '([a-z]+)', 1)")).alias("w"))
    often = words.filter("length(w) > 2").groupBy("w").count().filter(F.col("count") >= n)
    return often.select(F.col("w").alias("source_term"), F.upper("w").alias("target_term"))


# ---------------------------------------------------------------- events
def v_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a problem log with its hot details as columns."""
    return ev_from(table(spark, sf_dir, "events"))


def ev_from(events: DataFrame) -> DataFrame:
    """The log view of an events table or stream."""
    ev = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END").alias("level"),
        F.expr("""CASE event_type
            WHEN 'error' THEN element_at(array('translation_retry', 'tts_segment_failed', 'ffmpeg_mux_failed',
                                               'network_request_timeout', 'file_pipeline_failed'), k % 5 + 1)
            WHEN 'signup' THEN element_at(array('translation_progress', 'translation_provider_response_rejected',
                                                'tts_retry', 'activity_heartbeat'), k % 4 + 1)
            WHEN 'purchase' THEN 'stage_finished'
            WHEN 'view' THEN CASE WHEN k % 20 = 0 THEN 'app_session_finished' ELSE 'stage_started' END
            ELSE CASE WHEN k % 2 = 0 THEN 'network_storm_started' ELSE 'network_storm_finished' END END""").alias("event"),
        F.expr("""CASE WHEN event_type IN ('error', 'signup')
            THEN concat('Request ', event_id, ' failed: https://host/p', k, '?token=', k, ' group ', chr(97 + k % 2))
            ELSE '' END""").alias("message"),
        F.expr("CASE WHEN event_type IN ('purchase', 'view') THEN concat('stage_', k % 6) END").alias("stage"),
        F.expr("CASE WHEN event_type = 'view' THEN concat('in/', k % 7, '.mp4') END").alias("input_path"),
        F.expr("CASE WHEN event_type = 'click' THEN element_at(array('edge_tts', 'gtts'), k % 3 % 2 + 1) END").alias("service"),
        F.expr("CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'ReadTimeout' END").alias("exc_type"),
        F.expr("""CASE WHEN event_type = 'error' AND k % 3 = 0
                  THEN concat('connect to host ', k, ' timed out') END""").alias("exc_message"),
        F.expr("event_type = 'error' AND k % 6 = 0").alias("has_traceback"),
        F.expr("CASE WHEN event_type = 'purchase' THEN floor(value) END").cast("double").alias("elapsed_sec"))


def v_req(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls to five services."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("service"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.expr("CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'request' END").alias("kind"),
        F.expr("CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'rate_limit' ELSE 'timeout' END END").alias("reason"))


# ---------------------------------------------------------------- jobs, files, inventories
def v_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queued jobs."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.expr("o_orderkey - o_orderkey % 13 % 2")).alias("task_id"), F.col("o_orderkey").alias("ord"),
        F.expr("""CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed'
                                                          WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'completed' END
                       WHEN o_orderstatus = 'O' THEN 'running'
                       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'paused' ELSE 'queued' END""").alias("status"),
        F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'cancellation_requested'
                  WHEN '3-MEDIUM' THEN 'worker_failed' ELSE 'running' END""").alias("batch_status"),
        F.expr("""CASE WHEN o_orderkey % 9 = 0 THEN 'bad'
                  ELSE cast(cast(floor(o_totalprice / 4000) AS bigint) - 5 AS string) END""").alias("progress"),
        F.col("o_orderdate").alias("created_at"), F.expr("concat('in/', o_custkey, '.mp4')").alias("current_path"))


def v_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as the files of those jobs."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_key"), F.col("l_linenumber").cast("bigint").alias("file_index"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.expr("""CASE concat(l_returnflag, l_linestatus) WHEN 'RF' THEN 'failed' WHEN 'AO' THEN 'pending'
                  WHEN 'AF' THEN 'processing' WHEN 'NF' THEN 'missing' ELSE 'succeeded' END""").alias("status"),
        F.expr("concat('in/', l_partkey, '.mp4')").alias("input_path"),
        F.expr("""CASE WHEN l_partkey % 10 = 0 THEN ''
                  ELSE concat('out/', l_orderkey, '_', l_linenumber, '.mp4') END""").alias("output_path"),
        F.expr("CASE WHEN l_suppkey % 10 <> 0 THEN cast(floor(l_extendedprice) AS bigint) END").alias("size"),
        F.expr("cast(datediff(l_shipdate, date'1970-01-01') AS bigint) * 86400").alias("modified"), F.col("l_quantity").alias("elapsed_sec"))


def v_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as cache files: a sound file and, mostly, its description."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("root"), F.expr("concat(l_orderkey, '-', l_linenumber)").alias("key"),
        F.expr("""CASE WHEN l_linestatus = 'O' THEN '.json' WHEN l_returnflag = 'R' THEN '.wav'
                  ELSE '.mp3' END""").alias("suffix"),
        F.expr("cast(l_quantity * 1000 AS bigint)").alias("size"), F.expr("cast(datediff(l_shipdate, date'1970-01-01') AS bigint) * 86400").alias("mtime"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'prepared_wav_2' ELSE 'edge_tts' END").alias("provider"))


AS_OF = 1007164800  # 2001-12-01 00:00:00 UTC

# ---------------------------------------------------------------- the same views as SQL
SQL: dict[str, str] = {
    "v_seg": """SELECT conv_id AS media_id, turn AS ord, text, role,
        turn * 2e0 + 0.125e0 * ((conv_id * 7 + turn * 13) % 8) AS "start",
        turn * 2e0 + 0.125e0 * ((conv_id * 7 + turn * 13) % 8) + 0.125e0 * (4 + length(text) % 12) AS "end"
        FROM conversations""",
    "v_media": """SELECT media_id, max("end") + 0.5e0 AS video_dur,
        CASE WHEN media_id % 2 = 0 THEN 25e0 ELSE 30e0 END AS fps FROM v_seg GROUP BY media_id""",
    "v_tts": """SELECT *, CASE WHEN (media_id + ord) % 17 <> 0 THEN 0.125e0 * (3 + length(text) % 40) END AS tts_dur,
        ['edge_tts', 'gtts', 'piper'][ord % 3 + 1] AS provider FROM v_seg""",
    "v_asr": """SELECT media_id, ord, "start", "end",
        CASE WHEN media_id % 5 = 0 THEN 'Phrase, no. ' || (ord // 3) ELSE text END AS text,
        -0.125e0 * (ord % 12) AS avg_logprob, 1 + 0.125e0 * (length(text) % 16) AS compression_ratio,
        0.125e0 * (ord % 8) AS no_speech_prob, 0.125e0 * (media_id % 8) AS temperature,
        ord % 4 <> 0 AS has_words FROM v_seg""",
    "v_slots": """SELECT s.*, greatest(0.05e0, s."end" - s."start") AS spoken_slot,
        greatest(0e0, least(video_dur, until_s) - s."start") AS hard_slot,
        greatest(0.08e0, greatest(0e0, least(video_dur, until_s) - s."start") * 0.99e0) AS target_slot
        FROM (SELECT v.*, m.video_dur, CASE WHEN lead(v."start") OVER w IS NULL THEN greatest(v."end", m.video_dur)
                ELSE greatest(v."start", lead(v."start") OVER w - 0.045e0) END AS until_s
              FROM v_tts v JOIN v_media m USING (media_id)
              WINDOW w AS (PARTITION BY v.media_id ORDER BY v."start", v.ord)) s""",
    "v_placed": """SELECT *, "start" + before_sec AS shifted_start, CAST(floor(("start" + before_sec) * 1000) AS BIGINT) AS delay_ms,
        CASE WHEN pause_extra > 0 THEN least(video_dur, "start" + hard_slot) END AS freeze_at
        FROM (SELECT *, coalesce(sum(pause_extra) OVER (PARTITION BY media_id ORDER BY "start", ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before_sec
              FROM (SELECT *, CASE WHEN tts_dur + 0.055e0 - hard_slot >= 0.035e0 THEN tts_dur + 0.055e0 - hard_slot
                      ELSE 0e0 END AS pause_extra FROM v_slots WHERE tts_dur IS NOT NULL))""",
    "v_pair": f"""SELECT doc_id AS pair_id, source AS media_id,
        CASE WHEN url IS NULL THEN text ELSE text || ' ' || url END AS source,
        CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 0 THEN replace(text, '3', '4')
             WHEN doc_id % 13 = 0 THEN '{ERROR_PAGE}' WHEN doc_id % 7 = 0 THEN 'ok'
             WHEN doc_id % 4 = 0 THEN lower(text || ' ' || coalesce(url, ''))
             ELSE text || ' ' || coalesce(url, '') END AS translated, lang AS source_lang,
        CASE WHEN doc_id % 2 = 0 THEN 'ru' ELSE lang END AS target_lang
        FROM documents LEFT JOIN (SELECT page_id AS doc_id, url FROM pages) USING (doc_id)""",
    "v_resp": """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Error 503 Service Unavailable'
             WHEN 1 THEN text || ' please solve the captcha'
             WHEN 2 THEN '<html><title>500</title> Server error </html>'
             WHEN 3 THEN '500 There was an error. Please try again later. Server error'
             WHEN 4 THEN '   ' WHEN 5 THEN '<body>' || text ELSE text END AS text,
        CASE WHEN doc_id % 4 = 0 THEN text || ' about a server error' ELSE text END AS source FROM documents""",
    "v_key": r"""SELECT *, sha256(printf('%.3f', "start") || chr(10) || printf('%.3f', "end") || chr(10)
        || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS segment_key FROM v_seg""",
    "v_ckpt": """SELECT media_id, segment_key AS key, CASE WHEN (media_id + ord) % 7 = 0 THEN 'Error 503 Service Unavailable'
        ELSE lower(text) END AS translated FROM v_key WHERE role <> 'user'""",
    "v_gloss": """SELECT w AS source_term, upper(w) AS target_term FROM (
        SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark)
        WHERE length(w) > 2 GROUP BY w HAVING count(*) >= 5)""",
    "v_ev": r"""SELECT user_id AS session_id, event_id AS sequence, ts,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
        CASE event_type
            WHEN 'error' THEN ['translation_retry', 'tts_segment_failed', 'ffmpeg_mux_failed',
                               'network_request_timeout', 'file_pipeline_failed'][k % 5 + 1]
            WHEN 'signup' THEN ['translation_progress', 'translation_provider_response_rejected',
                                'tts_retry', 'activity_heartbeat'][k % 4 + 1]
            WHEN 'purchase' THEN 'stage_finished'
            WHEN 'view' THEN CASE WHEN k % 20 = 0 THEN 'app_session_finished' ELSE 'stage_started' END
            ELSE CASE WHEN k % 2 = 0 THEN 'network_storm_started' ELSE 'network_storm_finished' END END AS event,
        CASE WHEN event_type IN ('error', 'signup')
            THEN 'Request ' || event_id || ' failed: https://host/p' || k || '?token=' || k || ' group ' || chr(97 + k % 2)
            ELSE '' END AS message,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'stage_' || (k % 6) END AS stage,
        CASE WHEN event_type = 'view' THEN 'in/' || (k % 7) || '.mp4' END AS input_path,
        CASE WHEN event_type = 'click' THEN ['edge_tts', 'gtts'][k % 3 % 2 + 1] END AS service,
        CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'ReadTimeout' END AS exc_type,
        CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'connect to host ' || k || ' timed out' END AS exc_message,
        event_type = 'error' AND k % 6 = 0 AS has_traceback,
        CASE WHEN event_type = 'purchase' THEN floor(value) END AS elapsed_sec
        FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)""",
    "v_req": """SELECT user_id % 5 AS service, ts, event_id AS seq,
        CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'request' END AS kind,
        CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'rate_limit' ELSE 'timeout' END END AS reason
        FROM events""",
    "v_task": """SELECT 't' || (o_orderkey - o_orderkey % 13 % 2) AS task_id, o_orderkey AS ord,
        CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed'
                                                WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'completed' END
             WHEN o_orderstatus = 'O' THEN 'running'
             WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'paused' ELSE 'queued' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'cancellation_requested'
             WHEN '3-MEDIUM' THEN 'worker_failed' ELSE 'running' END AS batch_status,
        CASE WHEN o_orderkey % 9 = 0 THEN 'bad'
             ELSE CAST(CAST(floor(o_totalprice / 4000) AS BIGINT) - 5 AS VARCHAR) END AS progress,
        o_orderdate AS created_at, 'in/' || o_custkey || '.mp4' AS current_path FROM orders""",
    "v_file": """SELECT l_orderkey AS task_key, CAST(l_linenumber AS BIGINT) AS file_index, l_partkey AS partkey,
        l_suppkey AS suppkey,
        CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'failed' WHEN 'AO' THEN 'pending'
             WHEN 'AF' THEN 'processing' WHEN 'NF' THEN 'missing' ELSE 'succeeded' END AS status,
        'in/' || l_partkey || '.mp4' AS input_path,
        CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'out/' || l_orderkey || '_' || l_linenumber || '.mp4' END AS output_path,
        CASE WHEN l_suppkey % 10 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS size,
        CAST(epoch(l_shipdate) AS BIGINT) AS modified, l_quantity AS elapsed_sec FROM lineitem""",
    "v_inv": """SELECT l_suppkey AS root, l_orderkey || '-' || l_linenumber AS key,
        CASE WHEN l_linestatus = 'O' THEN '.json' WHEN l_returnflag = 'R' THEN '.wav' ELSE '.mp3' END AS suffix,
        CAST(l_quantity * 1000 AS BIGINT) AS size, CAST(epoch(l_shipdate) AS BIGINT) AS mtime,
        CASE WHEN l_returnflag = 'R' THEN 'prepared_wav_2' ELSE 'edge_tts' END AS provider FROM lineitem""",
}
NEEDS = {"v_media": ["v_seg"], "v_tts": ["v_seg"], "v_asr": ["v_seg"], "v_slots": ["v_tts", "v_media"],
         "v_placed": ["v_slots"], "v_key": ["v_seg"], "v_ckpt": ["v_key"]}


def with_views(body: str, *views: str, **more: str) -> str:
    """``body`` under a WITH clause holding the views it needs, then ``more``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{v} AS ({SQL[v]})" for v in ordered] + [f"{k} AS ({q})" for k, q in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
