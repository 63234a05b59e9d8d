"""Queries over jobs and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as jb
from ..sources import readers as rd
from . import views as v
from .registry import register
from .views import with_views


def _tasks(spark, sf):
    """Orders as tasks with their own number as id."""
    return v.v_task(spark, sf).withColumn("task_id", F.col("ord"))


def _files(spark, sf):
    return v.v_file(spark, sf).withColumnRenamed("task_key", "task_id").withColumn("last_error", F.lit(None).cast("string"))


NORM = """SELECT *, CASE WHEN status IN ('queued', 'interrupted', 'completed', 'failed', 'cancelled', 'running') THEN status ELSE 'interrupted' END AS st,
        greatest(0, least(100, coalesce(TRY_CAST(progress AS BIGINT), 0))) AS pr FROM v_task"""


@register("normalize_settings", """
    SELECT p_partkey, greatest(50, least(150, p_size * 4)) AS voice_volume_pct, greatest(0, least(220, coalesce(TRY_CAST(p_brand[7:] AS INT) * 10, 55))) AS highpass_hz,
        CASE WHEN p_retailprice * 4 < 2500 THEN 0 ELSE CAST(floor(least(16000, p_retailprice * 4)) AS INT) END AS lowpass_hz,
        greatest(-24, least(-12, -p_size)) AS master_loudness_i,
        CASE WHEN p_size % 3 = 0 THEN 1.15e0 WHEN 1 + p_size * 0.01e0 >= 1.23e0 THEN 1.25e0 WHEN 1 + p_size * 0.01e0 >= 1.18e0 THEN 1.2e0 ELSE 1.15e0 END AS speech_speed_limit
    FROM part""")
def _(spark, sf):
    raw = v.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 4).cast("string").alias("voice_volume_pct"),
        F.expr("concat(substr(p_brand, 7), CASE WHEN length(p_brand) > 6 THEN '0' ELSE '' END)").alias("highpass_hz"),
        (F.col("p_retailprice") * 4).cast("bigint").cast("string").alias("lowpass_hz"),
        (-F.col("p_size")).cast("string").alias("master_loudness_i"), F.lit("x").alias("noise_reduction"),
        # just off the middle between two limits, so no tie arises
        F.expr("CASE WHEN p_size % 3 = 0 THEN 'fast' ELSE cast(1 + p_size * 0.01D AS string) END").alias("speech_speed_limit"))
    return jb.normalize_settings(raw).drop("noise_reduction")


@register("normalize_tasks", with_views("SELECT ord, st AS status, CAST(pr AS INT) AS progress FROM n", "v_task", n=NORM))
def _(spark, sf):
    return jb.normalize_tasks(v.v_task(spark, sf)).select("ord", "status", "progress")


@register("normalize_files", with_views("""
    SELECT task_key, file_index, status, output_path, elapsed_sec FROM (SELECT task_key, CASE WHEN partkey % 7 = 0 THEN suppkey ELSE file_index END AS file_index,
        CASE WHEN partkey % 11 = 0 THEN 'pending' ELSE status END AS status, output_path,
        CASE WHEN partkey % 5 = 0 THEN 0e0 ELSE elapsed_sec END AS elapsed_sec FROM v_file)""", "v_file").replace("THEN suppkey ELSE", "THEN greatest(1, suppkey) ELSE"))
def _(spark, sf):
    raw = v.v_file(spark, sf).select(
        "task_key", F.expr("CASE WHEN partkey % 7 = 0 THEN 'x' ELSE cast(file_index AS string) END").alias("file_index"),
        F.col("suppkey").alias("position"), F.expr("CASE WHEN partkey % 11 = 0 THEN '' ELSE status END").alias("status"),
        "input_path", "output_path", F.lit(None).cast("string").alias("last_error"),
        F.expr("CASE WHEN partkey % 10 = 0 THEN 'NaN' WHEN partkey % 5 = 0 THEN '-3' ELSE cast(elapsed_sec AS string) END").alias("elapsed_sec"))
    return jb.normalize_files(raw).select("task_key", "file_index", "status", "output_path", "elapsed_sec")


@register("pending_files", with_views("SELECT task_key, file_index, partkey, status FROM v_file WHERE status <> 'succeeded'", "v_file"))
def _(spark, sf):
    return jb.pending_files(v.v_file(spark, sf)).select("task_key", "file_index", "partkey", "status")


@register("runnable_tasks", with_views("SELECT ord, st AS status FROM n WHERE st IN ('queued', 'interrupted')", "v_task", n=NORM))
def _(spark, sf):
    return jb.runnable_tasks(jb.normalize_tasks(v.v_task(spark, sf))).select("ord", "status")


@register("next_task", with_views("SELECT ord, st AS status FROM n WHERE st IN ('queued', 'interrupted') ORDER BY ord LIMIT 1", "v_task", n=NORM))
def _(spark, sf):
    return jb.next_task(jb.normalize_tasks(v.v_task(spark, sf))).select("ord", "status")


@register("recover_tasks", with_views("""
    SELECT ord, new AS status, CASE WHEN cancel THEN 'cancelled' WHEN new <> 'completed' AND (run OR batch_status IN ('running', 'cancellation_requested', 'worker_failed'))
        THEN 'interrupted' ELSE batch_status END AS batch_status, CASE WHEN done THEN 100 ELSE pr END AS progress
    FROM (SELECT *, CASE WHEN cancel THEN 'cancelled' WHEN done THEN 'completed' WHEN run THEN 'interrupted' ELSE st END AS new
        FROM (SELECT n.*, st = 'running' AS run, st = 'running' AND batch_status = 'cancellation_requested' AS cancel,
                st = 'running' AND batch_status = 'completed' AND coalesce(all_ok, false) AS done
            FROM n LEFT JOIN (SELECT task_key, bool_and(status <> 'failed' AND output_path <> '') AS all_ok FROM (
                SELECT * REPLACE (CASE WHEN status IN ('succeeded', 'pending', 'processing', 'missing') THEN 'succeeded' ELSE status END AS status) FROM v_file)
                GROUP BY task_key) f ON f.task_key = n.ord))""", "v_task", "v_file", n=NORM))
def _(spark, sf):
    # every file but the failed ones counts as finished, so that whole tasks complete
    files = _files(spark, sf).withColumn("status", F.when(F.col("status") == "failed", "failed").otherwise("succeeded"))
    outputs = files.filter("output_path <> ''").select("output_path")
    out = jb.recover_tasks(jb.normalize_tasks(_tasks(spark, sf)), files, outputs)
    return out.select("ord", "status", "batch_status", "progress")


ROLL = """SELECT task_key AS task_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS successful,
        count(*) FILTER (status IN ('failed', 'missing')) AS failed, count(*) FILTER (status <> 'succeeded') AS pending FROM v_file GROUP BY task_key"""


@register("batch_rollup", with_views("""SELECT r.*, CASE WHEN o_orderpriority = '2-HIGH' THEN 'cancelled' WHEN successful = total THEN 'completed' ELSE 'completed_with_errors' END AS status
    FROM r LEFT JOIN orders ON o_orderkey = task_id""", "v_file", r=ROLL))
def _(spark, sf):
    stopped = v.table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("task_id"))
    return jb.batch_rollup(_files(spark, sf), stopped)


@register("finish_tasks", with_views("""
    SELECT ord, CASE WHEN successful IS NULL THEN st WHEN successful = total THEN 'completed' WHEN ord % 5 = 0 THEN 'interrupted'
        WHEN batch_status = 'cancellation_requested' THEN 'cancelled' ELSE 'failed' END AS status,
        CASE WHEN successful = total THEN 100 ELSE pr END AS progress FROM n LEFT JOIN r ON r.task_id = ord""", "v_task", "v_file", n=NORM, r=ROLL))
def _(spark, sf):
    tasks = jb.normalize_tasks(_tasks(spark, sf))
    results = (jb.batch_rollup(_files(spark, sf)).select("task_id", "successful", "total")
               .join(tasks.select("task_id", (F.col("batch_status") == "cancellation_requested").alias("cancelled"),
                                  (F.col("ord") % 5 == 0).alias("closing")), "task_id"))
    return jb.finish_tasks(tasks, results).select("ord", "status", "progress")


@register("requeue_tasks", with_views("""SELECT ord, CASE WHEN st IN ('running', 'completed') THEN st ELSE 'queued' END AS status,
    CASE WHEN st IN ('running', 'completed') THEN batch_status ELSE 'queued' END AS batch_status,
    CASE WHEN st IN ('running', 'completed') THEN pr ELSE 0 END AS progress FROM n""", "v_task", n=NORM))
def _(spark, sf):
    return jb.requeue_tasks(jb.normalize_tasks(v.v_task(spark, sf))).select("ord", "status", "batch_status", "progress")


@register("clear_finished", with_views("SELECT ord, st AS status FROM n WHERE st NOT IN ('completed', 'failed', 'cancelled')", "v_task", n=NORM))
def _(spark, sf):
    return jb.clear_finished(jb.normalize_tasks(v.v_task(spark, sf))).select("ord", "status")


@register("repair_task_ids", with_views("""
    SELECT ord, CASE WHEN rn > 1 THEN task_id || '__recovered_' || rn ELSE task_id END AS task_id, CASE WHEN rn > 1 THEN 'failed' ELSE st END AS status, rn > 1 AS repaired
    FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS rn FROM n)""", "v_task", n=NORM))
def _(spark, sf):
    return jb.repair_task_ids(jb.normalize_tasks(v.v_task(spark, sf))).select("ord", "task_id", "status", "repaired")


@register("assign_unique_names", """
    WITH RECURSIVE req AS (SELECT o_custkey % 500 AS base, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) AS k FROM orders),
    used AS (SELECT DISTINCT l_partkey % 500 AS base, CAST(l_linenumber AS BIGINT) * 2 - 1 AS number FROM lineitem WHERE l_quantity = 7 AND l_returnflag = 'R'),
    wanted AS (SELECT base, max(k) AS n FROM req GROUP BY base),
    free AS (SELECT base, number, row_number() OVER (PARTITION BY base ORDER BY number) AS k FROM (
        SELECT base, unnest(range(1, n + 20)) AS number FROM wanted) c WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.base = c.base AND used.number = c.number))
    SELECT 'out' AS folder, ord, 'clip' || base || '_TR' || CASE WHEN number > 1 THEN '_' || number ELSE '' END || '.mp4' AS output_name
    FROM req JOIN free USING (base, k)""")
def _(spark, sf):
    asked = v.table(spark, sf, "orders").select(
        F.lit("out").alias("folder"), F.expr("concat('clip', o_custkey % 500)").alias("base"), F.col("o_orderkey").alias("ord"))
    taken = v.table(spark, sf, "lineitem").filter("l_quantity = 7 AND l_returnflag = 'R'").select(
        F.lit("out").alias("folder"), F.expr("""concat('clip', l_partkey % 500, '_TR', CASE WHEN l_linenumber > 1
            THEN concat('_', l_linenumber * 2 - 1) ELSE '' END, '.mp4')""").alias("name")).distinct()
    return jb.assign_unique_names(asked, taken).select("folder", "ord", "output_name")


CURRENT = """SELECT 'in/' || p_partkey || '.mp4' AS input_path, CAST(floor(p_retailprice) AS BIGINT) * 20 AS size, 899251200 AS modified FROM part WHERE p_size > 5"""


def _current(spark, sf):
    return v.table(spark, sf, "part").filter("p_size > 5").select(
        F.expr("concat('in/', p_partkey, '.mp4')").alias("input_path"),
        F.expr("cast(floor(p_retailprice) AS bigint) * 20").alias("size"), F.lit(899251200).cast("bigint").alias("modified"))


def _stored(spark, sf):
    """Files whose recorded size agrees with the present one where the amount is even."""
    size = F.expr("CASE WHEN suppkey % 10 = 0 THEN NULL WHEN elapsed_sec % 2 = 0 THEN (900 + partkey div 10) * 20 ELSE size END")
    return _files(spark, sf).withColumn("size", size).withColumn("modified", F.lit(899251200).cast("bigint"))


STORED = """SELECT * REPLACE (CASE WHEN suppkey % 10 = 0 THEN NULL WHEN elapsed_sec % 2 = 0 THEN (900 + partkey // 10) * 20 ELSE size END AS size, 899251200 AS modified) FROM v_file"""
CHANGED = """SELECT s.*, c.input_path IS NOT NULL AS present, CASE WHEN suppkey % 13 = 0 THEN true WHEN s.size IS NULL THEN false ELSE
        s.size <> coalesce(c.size, -1) OR s.modified <> coalesce(c.modified, -2) END AS changed FROM stored s LEFT JOIN cur c USING (input_path)"""


@register("input_changed", with_views("SELECT task_key, file_index, partkey, suppkey, elapsed_sec, changed FROM ch", "v_file", cur=CURRENT, stored=STORED, ch=CHANGED))
def _(spark, sf):
    stored = _stored(spark, sf).withColumn("readable", F.col("suppkey") % 13 != 0)
    return jb.input_changed(stored, _current(spark, sf)).select(
        F.col("task_id").alias("task_key"), "file_index", "partkey", "suppkey", "elapsed_sec", "changed")


VALID_OUT = "SELECT DISTINCT output_path FROM v_file WHERE output_path <> '' AND elapsed_sec > 10"


@register("resume_plan", with_views("""
    SELECT task_key, file_index, partkey, suppkey, elapsed_sec, CASE WHEN status = 'succeeded' AND ok AND NOT changed THEN 'keep' WHEN NOT present THEN 'missing'
        WHEN status = 'succeeded' THEN 'redo' WHEN ok AND NOT changed THEN 'recovered' ELSE 'process' END AS action
    FROM (SELECT ch.* REPLACE (present AND CASE WHEN size IS NULL THEN false ELSE changed END AS changed), v.output_path IS NOT NULL AS ok
        FROM ch LEFT JOIN valid v ON v.output_path = ch.output_path)""", "v_file", cur=CURRENT, stored=STORED, ch=CHANGED.replace("CASE WHEN suppkey % 13 = 0 THEN true WHEN", "CASE WHEN"), valid=VALID_OUT))
def _(spark, sf):
    valid = _files(spark, sf).filter("output_path <> '' AND elapsed_sec > 10").select("output_path")
    return jb.resume_plan(_stored(spark, sf), _current(spark, sf), valid).select(
        F.col("task_id").alias("task_key"), "file_index", "partkey", "suppkey", "elapsed_sec", "action")


@register("files_to_redo", with_views("""SELECT task_key, file_index, partkey, status FROM v_file WHERE status <> 'succeeded'
    OR output_path IN (SELECT output_path FROM v_file WHERE elapsed_sec < 5)""", "v_file"))
def _(spark, sf):
    lost = _files(spark, sf).filter("elapsed_sec < 5").select("output_path")
    return jb.files_to_redo(_files(spark, sf), lost).select(F.col("task_id").alias("task_key"), "file_index", "partkey", "status")


@register("drop_tombstoned", """SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, sf):
    known = v.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task_id"))
    return jb.drop_tombstoned(_tasks(spark, sf).select("task_id"), known)


@register("dedupe_keep_first", """SELECT task_id, min(ord) AS ord FROM (SELECT 't' || (o_orderkey - o_orderkey % 13 % 2) AS task_id, o_orderkey AS ord FROM orders) GROUP BY task_id""")
def _(spark, sf):
    return jb.dedupe_keep_first(v.v_task(spark, sf).select("task_id", "ord"), "task_id", "ord")


@register("fork_changed_batches", with_views("""
    SELECT CASE WHEN same THEN CAST(task_key AS VARCHAR) ELSE task_key || '_new' END AS batch_id, file_index, partkey, CASE WHEN same THEN 'resume' ELSE 'fork' END AS batch_action,
        CASE WHEN same THEN output_path ELSE '' END AS output_path
    FROM v_file JOIN (SELECT o_orderkey, o_orderstatus <> 'F' AS same FROM orders) ON o_orderkey = task_key WHERE status <> 'succeeded'""", "v_file"))
def _(spark, sf):
    orders = v.table(spark, sf, "orders")
    batches = orders.select(F.col("o_orderkey").alias("batch_id"), F.lit('{"voice":"a"}').alias("settings"))
    new = orders.select(F.col("o_orderkey").alias("batch_id"),
                        F.expr("""CASE WHEN o_orderstatus = 'F' THEN '{"voice":"b"}' ELSE '{"voice":"a"}' END""").alias("new_settings"))
    files = _files(spark, sf).withColumnRenamed("task_id", "batch_id")
    return jb.fork_changed_batches(batches, files, new).select("batch_id", "file_index", "partkey", "batch_action", "output_path")


LABELS = "CASE st WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Running' WHEN 'completed' THEN 'Done' WHEN 'failed' THEN 'Failed' WHEN 'cancelled' THEN 'Cancelled' ELSE 'Interrupted' END"


@register("task_snapshot", with_views(f"""
    SELECT ord AS task_id, st AS status, {LABELS} AS status_label, CAST(pr AS INT) AS progress, coalesce(total, 0) AS files_total, coalesce(successful, 0) AS succeeded,
        coalesce(r.failed, 0) AS failed, coalesce(processing, 0) AS processing, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM n LEFT JOIN r ON r.task_id = ord LEFT JOIN (SELECT task_key, count(*) AS processing FROM v_file WHERE status = 'processing' GROUP BY 1) p ON p.task_key = ord""",
    "v_task", "v_file", n=NORM, r=ROLL))
def _(spark, sf):
    return jb.task_snapshot(_tasks(spark, sf), _files(spark, sf))


@register("file_snapshot", with_views("""
    SELECT task_key AS task_id, file_index, status, CASE status WHEN 'pending' THEN 'Waiting' WHEN 'processing' THEN 'In progress' WHEN 'succeeded' THEN 'Done'
            WHEN 'failed' THEN 'Error' ELSE 'File not available' END AS status_label, partkey || '.mp4' AS input_name,
        CASE WHEN output_path = '' THEN '—' ELSE output_path[5:] END AS output_name, '0:' || lpad(CAST(CAST(elapsed_sec AS INT) AS VARCHAR), 2, '0') AS elapsed,
        status = 'processing' OR coalesce(partkey = o_custkey, false) AS is_current
    FROM v_file LEFT JOIN orders ON o_orderkey = task_key""", "v_file"))
def _(spark, sf):
    tasks = _tasks(spark, sf).withColumn("current_file", F.regexp_extract("current_path", "([^/]*)$", 1))
    return jb.file_snapshot(_files(spark, sf), tasks)


@register("reconstruct_batches", """
    WITH f AS (SELECT user_id, event_id, event_type, 'in/' || (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 5) || '.mp4' AS p, value FROM events),
    last AS (SELECT user_id, p, max_by(CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END, event_id) FILTER (event_type IN ('view', 'purchase', 'error')) AS status,
        coalesce(max_by(CASE WHEN event_type = 'view' THEN 'out/' || event_id ELSE 'final/' || event_id END, event_id) FILTER (event_type IN ('view', 'click')), '') AS output_path,
        max_by(floor(value), event_id) FILTER (event_type IN ('purchase', 'error')) AS elapsed_sec,
        bool_or(event_type = 'error') AS bad FROM f GROUP BY user_id, p)
    SELECT u.user_id AS session_id, i AS file_index, coalesce(status, 'pending') AS status, coalesce(output_path, '') AS output_path, coalesce(elapsed_sec, 0e0) AS elapsed_sec,
        CASE WHEN bad THEN 'not finished in the earlier session' ELSE '' END AS last_error, CASE WHEN u.user_id % 3 = 0 THEN 'completed' ELSE 'interrupted' END AS batch_status
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 6)) AS i) LEFT JOIN last ON last.user_id = u.user_id AND last.p = 'in/' || (i - 1) || '.mp4'
    """.replace("\\\\", "\\"))
def _(spark, sf):
    ev = v.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    names = {"view": "batch_file_started", "purchase": "batch_file_finished", "error": "batch_file_finished", "click": "file_pipeline_finished"}
    event = F.lit("other")
    for kind, name in names.items():
        event = F.when(F.col("event_type") == kind, name).otherwise(event)
    none = F.lit(None)
    told = ev.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("sequence"), event.alias("event"),
        none.cast("array<string>").alias("files"), none.cast("string").alias("output_dir"),
        F.expr("concat('IN//', k % 5, '.mp4')").alias("input_path"), F.expr("concat('out/', event_id)").alias("output_path"),
        F.expr("concat('final/', event_id)").alias("final_path"), (F.col("event_type") == "purchase").alias("success"),
        F.floor("value").cast("double").alias("elapsed_sec"), none.cast("int").alias("successful"), none.cast("int").alias("total"))
    edge = ev.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    paths = F.array(*[F.lit(f"in/{i}.mp4") for i in range(5)])
    ends = edge.select(F.col("user_id").alias("session_id"), F.explode(F.array(
        F.struct((F.col("a") - 1).alias("sequence"), F.lit("batch_started").alias("event")),
        F.struct((F.col("z") + 1).alias("sequence"), F.lit("batch_finished").alias("event")))).alias("e")).select(
        "session_id", "e.sequence", "e.event", paths.alias("files"), F.lit("out").alias("output_dir"),
        F.expr("CASE WHEN session_id % 3 = 0 THEN 5 ELSE 4 END").alias("successful"), F.lit(5).alias("total"))
    out = jb.reconstruct_batches(told.unionByName(ends, allowMissingColumns=True))
    return out.select("session_id", "file_index", "status", "output_path", "elapsed_sec", "last_error", "batch_status")


#: Stored state rows: sound ones, and of three kinds of damage.
_STATES = """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN '{"schema_version": 1, "tasks": [' WHEN o_orderkey % 7 = 0 THEN '[' || o_orderkey || ']'
        WHEN o_orderkey % 5 = 0 THEN '{"schema_version": ' || o_orderkey % 3 || ', "tasks": []}' WHEN o_orderkey % 3 = 0 THEN '{"schema_version": 1}'
        ELSE '{"schema_version": 1, "tasks": [' || o_orderkey || ']}' END AS value FROM orders"""


@register("split_corrupt", f"""
    SELECT ord, value, CASE WHEN ord % 11 = 0 OR ord % 7 = 0 THEN 'corrupt' WHEN ord % 5 = 0 AND ord % 3 <> 1 THEN 'unsupported' WHEN ord % 5 <> 0 AND ord % 3 = 0 THEN 'partial' ELSE 'good' END AS label
    FROM ({_STATES})""")
def _(spark, sf):
    """Quarantined rows with their label and raw text, and the rows that go on."""
    raw = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.expr(_STATES[len("SELECT o_orderkey AS ord, "):-len(" AS value FROM orders")]).alias("value"))
    state = F.try_parse_json("value")
    good, kept = rd.split_corrupt(raw, F.try_variant_get(state, "$.tasks", "array<variant>").isNotNull(), F.try_variant_get(state, "$.schema_version", "int"))
    return good.withColumn("label", F.lit("good")).unionByName(kept).select("ord", "value", "label")
