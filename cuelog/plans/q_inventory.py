"""Queries over inventories and catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import catalog_fingerprint
from ..functions.text import cap_list
from ..operators import inventory as iv
from ..session import shared_folder
from ..sources import readers as rd
from ..sources import writers as wr
from . import views as v
from .registry import register
from .views import AS_OF, with_views


@register("retention_plan", f"""
    SELECT root, path, CASE WHEN mtime < {AS_OF} - 1000 * 86400 THEN 'expired' WHEN n > 80 THEN 'beyond_newest' ELSE '' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY mtime DESC, path) AS n FROM (
        SELECT o_custkey % 40 AS root, 's' || o_orderkey AS path, CAST(epoch(o_orderdate) AS BIGINT) AS mtime FROM orders))""")
def _(spark, sf):
    sessions = v.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("root"), F.expr("concat('s', o_orderkey)").alias("path"),
        F.expr("cast(datediff(o_orderdate, date'1970-01-01') AS bigint) * 86400").alias("mtime"))
    return iv.retention_plan(sessions, F.lit(AS_OF), days=1000).select("root", "path", "reason")


EVICT = f"""SELECT *, CASE WHEN gone THEN rule WHEN rule = '' AND total > 600000 AND total - freed > 400000 THEN 'size_limited' ELSE '' END AS reason
    FROM (SELECT *, coalesce(sum(CASE WHEN rule = '' THEN size ELSE 0 END) OVER (PARTITION BY root ORDER BY cls, last_used, key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed,
            sum(CASE WHEN gone THEN 0 ELSE size END) OVER (PARTITION BY root) AS total
        FROM (SELECT *, rule IN ('orphan', 'stale', 'prepared') AS gone, CASE WHEN prep THEN 0 ELSE 1 END AS cls
            FROM (SELECT *, CASE WHEN NOT (snd AND note) THEN CASE WHEN age >= 500 * 86400 THEN 'orphan' ELSE 'young_orphan' END
                        WHEN age >= 2000 * 86400 THEN 'stale' WHEN prep AND age >= 1000 * 86400 THEN 'prepared' ELSE '' END AS rule
                FROM (SELECT root, key, max(mtime) AS last_used, {AS_OF} - max(mtime) AS age, sum(size) AS size, count(*) AS files,
                        bool_or(suffix <> '.json') AS snd, bool_or(suffix = '.json') AS note,
                        bool_or(suffix = '.json' AND provider = 'prepared_wav_2') AS prep
                    FROM (SELECT * REPLACE (root % 50 AS root, regexp_extract(key, '^(\\d+)', 1) AS key) FROM v_inv) GROUP BY root, key))))""".replace("\\\\", "\\")


def _plan(spark, sf):
    # one entry per order and directory, so that sounds meet their descriptions
    entries = v.v_inv(spark, sf).withColumn("root", F.col("root") % 50).withColumn("key", F.regexp_extract("key", r"^(\d+)", 1))
    return iv.cache_eviction_plan(entries, F.lit(AS_OF), retention_days=2000, prepared_hours=24000, orphan_hours=12000,
                                  max_bytes=600000, target_bytes=400000)


@register("cache_eviction_plan", with_views("SELECT root, key, CAST(size AS BIGINT) AS size, files, reason FROM plan", "v_inv", plan=EVICT))
def _(spark, sf):
    return _plan(spark, sf).select("root", "key", "size", "files", "reason")


@register("retention_totals", with_views("""
    SELECT root, count(*) FILTER (reason <> '') AS deleted_entries, coalesce(CAST(sum(files) FILTER (reason <> '') AS BIGINT), 0) AS deleted_files,
        coalesce(CAST(sum(size) FILTER (reason <> '') AS BIGINT), 0) AS freed_bytes, coalesce(CAST(sum(size) FILTER (reason = '') AS BIGINT), 0) AS remaining_bytes,
        count(*) FILTER (reason = 'orphan') AS orphan_entries, count(*) FILTER (reason = 'stale') AS stale_entries,
        count(*) FILTER (reason = 'prepared') AS prepared_entries, count(*) FILTER (reason = 'size_limited') AS size_limited_entries
    FROM plan GROUP BY root""", "v_inv", plan=EVICT))
def _(spark, sf):
    return iv.retention_totals(_plan(spark, sf))


@register("inventory_size", with_views("SELECT root, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM v_inv GROUP BY root", "v_inv"))
def _(spark, sf):
    return iv.inventory_size(v.v_inv(spark, sf))


@register("reconcile_catalog", """
    SELECT p_partkey AS id, CASE WHEN coalesce(integrity, 'missing') <> 'ok' THEN 'repair_needed' WHEN changed THEN 'update_available' ELSE 'healthy' END AS action,
        coalesce(integrity, 'incomplete') AS integrity
    FROM (SELECT p_partkey, p_size % 2 = 0 AS changed FROM part) JOIN (
        SELECT l_partkey, max(CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'bad_checksum' END END) AS integrity
        FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity > 25 GROUP BY l_partkey) ON l_partkey = p_partkey""")
def _(spark, sf):
    catalog = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), catalog_fingerprint("p_brand", "p_type", "p_size").alias("fingerprint"), "p_size")
    items = v.table(spark, sf, "lineitem").filter("l_quantity > 25")
    found = items.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("id")).agg(
        F.max(F.expr("CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'bad_checksum' END")).alias("integrity"))
    manifests = items.filter("l_returnflag IN ('A', 'N')").select(F.col("l_partkey").alias("id")).distinct().join(
        catalog.select("id", F.expr("CASE WHEN p_size % 2 = 0 THEN 'older' ELSE fingerprint END").alias("installed_fingerprint")), "id")
    return iv.reconcile_catalog(catalog, found, manifests).select("id", "action", "integrity")


@register("plan_routes", """
    WITH sales AS (SELECT s_nationkey AS src, c_nationkey AS tgt, sum(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
    pairs AS (SELECT src, tgt FROM sales WHERE q >= (SELECT avg(q) * 1.2e0 FROM sales))
    SELECT s.src, s.tgt, CASE WHEN d.src IS NOT NULL THEN 1 WHEN s.src <> 3 AND s.tgt <> 3 AND a.src IS NOT NULL AND b.tgt IS NOT NULL THEN 2 ELSE 0 END AS n_hops
    FROM sales s LEFT JOIN pairs d ON d.src = s.src AND d.tgt = s.tgt LEFT JOIN pairs a ON a.src = s.src AND a.tgt = 3 LEFT JOIN pairs b ON b.src = 3 AND b.tgt = s.tgt""")
def _(spark, sf):
    sales = (v.table(spark, sf, "lineitem").join(v.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
             .join(v.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
             .join(v.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
             .filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("tgt"))
             .agg(F.sum("l_quantity").alias("q")))
    # a pair is installed if it sells a fifth more than the mean: a window over the aggregate, a row a pair of nations
    pairs = sales.withColumn("m", F.avg("q").over(Window.partitionBy()) * 1.2).filter("q >= m")
    return iv.plan_routes(sales.select("src", "tgt"), pairs, hub=3).select("src", "tgt", "n_hops")


@register("voice_order", """
    SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE WHEN p_partkey = 77 THEN 0 ELSE 1 END, p_partkey) AS rank
    FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#4' AND p_size > 3""")
def _(spark, sf):
    voices = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "SMALL", "voice").otherwise("model").alias("type"),
        F.col("p_brand").alias("language"), F.col("p_partkey").alias("ord"), (F.col("p_size") > 3).alias("usable"))
    return iv.voice_order(voices, "77", "Brand#4").select("id", "rank")


@register("cap_rows", """
    SELECT l_suppkey, l_orderkey, total_count, least(total_count, 20) AS shown_count, total_count > 20 AS truncated FROM (
        SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS total_count, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS rn FROM lineitem) WHERE rn <= 20""")
def _(spark, sf):
    return iv.cap_rows(v.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey"), ["l_suppkey"], "l_orderkey", 20)


@register("cap_list", r"""
    SELECT doc_id, total_count, least(total_count, 200) AS shown_count, total_count > 200 AS truncated FROM (
        SELECT doc_id, length(regexp_extract_all(text, '[A-Za-z]+')) AS total_count FROM documents)""".replace("length(regexp", "len(regexp"))
def _(spark, sf):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return v.table(spark, sf, "documents").select("doc_id", cap_list(words, 200).alias("c")).select(
        "doc_id", "c.total_count", "c.shown_count", "c.truncated")


# ---------------------------------------------------------------- written and read back
def _fresh(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("checkpoint_round_trip", with_views(r"""
    SELECT CAST(media_id AS VARCHAR) AS media_id, 'ru' AS target, start, "end", regexp_replace(text, '^\s+|\s+$', '', 'g') AS source,
        regexp_replace('to ' || text, '^\s+|\s+$', '', 'g') AS translated FROM v_seg WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""", "v_seg"))
def _(spark, sf):
    pairs = v.v_seg(spark, sf).select(F.col("media_id").cast("string").alias("media_id"), F.lit("ru").alias("target"), "start", "end",
                                      F.col("text").alias("source"), F.concat(F.lit("to "), "text").alias("translated"))
    path = _fresh(spark, "checkpoints")
    wr.write_checkpoints(pairs, path)
    return rd.read_checkpoints(spark, path).select("media_id", "target", "start", "end", "source", "translated")


@register("event_log_round_trip", with_views("""
    SELECT CAST(session_id AS VARCHAR) AS session_id, sequence, level, event, stage, service FROM v_ev""", "v_ev"))
def _(spark, sf):
    path = _fresh(spark, "logs")
    wr.write_event_log(v.v_ev(spark, sf), path)
    return rd.read_event_log(spark, path).select("session_id", "sequence", "level", "event", "stage", "service")


@register("write_transcripts", with_views(r"""
    SELECT media_id, part, count(*) AS segments, string_agg(t, chr(10) ORDER BY n) AS text FROM (
        SELECT media_id, t, n, (n - 1) // 1000 AS part FROM (
            SELECT media_id, trim(text) AS t, row_number() OVER (PARTITION BY media_id ORDER BY start, ord) AS n FROM v_seg WHERE trim(text) <> '')) GROUP BY ALL""", "v_seg"))
def _(spark, sf):
    return wr.to_transcript(v.v_seg(spark, sf), "text", 1000)


@register("latest_session", with_views("""
    SELECT session_id, status, updated_at FROM (SELECT session_id, CASE WHEN bool_or(event = 'app_session_finished') THEN 'closed' ELSE 'open' END AS status,
        CAST(epoch_us(max(ts)) AS BIGINT) AS updated_at FROM v_ev GROUP BY session_id) ORDER BY updated_at DESC, session_id DESC LIMIT 1""", "v_ev"))
def _(spark, sf):
    sessions = v.v_ev(spark, sf).groupBy("session_id").agg(
        F.when(F.bool_or(F.col("event") == "app_session_finished"), "closed").otherwise("open").alias("status"), F.unix_micros(F.max("ts")).alias("updated_at"))
    return wr.latest_session(wr.session_manifest(sessions))
