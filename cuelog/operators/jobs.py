"""Jobs and their files: normalising, recovery, resume, queue order.

Tasks: ``task_id``, ``ord`` (queue position), ``status``, ``batch_status``, ``progress``.
Files: ``task_id``, ``file_index``, ``status``, ``input_path``, ``output_path``, ``elapsed_sec``, ``last_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..functions.numbers import finite, fmt_clock, fmt_elapsed

# ---- fixed values: status words and limits ----
RUNNABLE = ["queued", "interrupted"]
TERMINAL = ["completed", "failed", "cancelled"]
KNOWN = [*RUNNABLE, *TERMINAL, "running"]
SPEED_LIMITS = [1.15, 1.20, 1.25]
# ---- end of fixed values ----

TASK_LABELS = {"queued": "Queued", "running": "Running", "completed": "Done", "failed": "Failed",
               "cancelled": "Cancelled", "interrupted": "Interrupted"}
FILE_LABELS = {"pending": "Waiting", "processing": "In progress", "succeeded": "Done", "failed": "Error",
               "missing": "File not available", "cancelled": "Cancelled"}


def _whole(column: str, default: int | Column) -> Column:
    """Text or number as a whole number; anything else is the default."""
    number = finite(column)
    text = F.col(column).try_cast("bigint")
    return F.coalesce(text, F.when(F.col(column).cast("string").rlike(r"^-?\d+(\.\d*)?$"), number.cast("bigint")),
                      default if isinstance(default, Column) else F.lit(default).cast("bigint"))


def normalize_settings(settings: DataFrame) -> DataFrame:
    """Clamp job settings to their ranges; the speed limit snaps to the nearest allowed one."""
    ranges = {"voice_volume_pct": (100, 50, 150), "highpass_hz": (55, 0, 220), "lowpass_hz": (0, 0, 16000),
              "master_loudness_i": (-16, -24, -12)}
    out = settings
    for name, (default, low, high) in ranges.items():
        value = F.greatest(F.lit(low), F.least(F.lit(high), _whole(name, default)))
        if name == "lowpass_hz":
            value = F.when(value < 2500, 0).otherwise(value)
        out = out.withColumn(name, value.cast("int"))
    asked = F.coalesce(finite("speech_speed_limit"), F.lit(1.15))
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.lit(s) - asked).alias("d"), F.lit(s).alias("s")) for s in SPEED_LIMITS]))
    return out.withColumn("speech_speed_limit", nearest["s"]).withColumn(
        "noise_reduction", F.coalesce(F.col("noise_reduction").try_cast("boolean"), F.lit(False)))


def normalize_files(files: DataFrame) -> DataFrame:
    """Repair file rows; ``position`` is the place in the stored list (from 1)."""
    elapsed = finite("elapsed_sec")
    index = _whole("file_index", F.col("position"))
    return (files.withColumn("file_index", F.greatest(F.lit(1), F.when(index == 0, F.col("position")).otherwise(index)))
            .withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")))
            .withColumn("input_path", F.coalesce("input_path", F.lit("")))
            .withColumn("output_path", F.coalesce("output_path", F.lit("")))
            .withColumn("elapsed_sec", F.when(elapsed >= 0, elapsed).otherwise(0.0))
            .withColumn("last_error", F.coalesce("last_error", F.lit(""))))


def normalize_tasks(tasks: DataFrame) -> DataFrame:
    """Unknown status becomes interrupted, progress a number from 0 to 100."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("queued"))
    progress = F.greatest(F.lit(0), F.least(F.lit(100), _whole("progress", 0)))
    return (tasks.withColumn("status", F.when(status.isin(KNOWN), status).otherwise("interrupted"))
            .withColumn("progress", progress.cast("int")))


def pending_files(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")) != "succeeded")


def runnable_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin(RUNNABLE))


def next_task(tasks: DataFrame) -> DataFrame:
    """The first runnable task in queue order; one row."""
    row = F.struct(*tasks.columns)
    return runnable_tasks(tasks).agg(F.min_by(row, "ord").alias("r")).filter("r IS NOT NULL").select("r.*")


def recover_tasks(tasks: DataFrame, files: DataFrame, outputs: DataFrame) -> DataFrame:
    """State of tasks after a restart.  ``outputs``: output_path of files that exist.

    A running task is cancelled if that was asked for, completed if its batch and
    every file finished and all outputs are there, else interrupted.
    """
    # files without an output have no key: NULL meets nothing, so they are not gathered at one
    there = outputs.select(F.nullif("output_path", F.lit("")).alias("_out")).filter("_out IS NOT NULL").distinct().withColumn("_there", F.lit(True))
    kept = files.withColumn("_out", F.nullif("output_path", F.lit(""))).join(there, "_out", "left").groupBy("task_id").agg(F.bool_and(
        (F.col("status") == "succeeded") & (F.trim("output_path") != "") & F.coalesce("_there", F.lit(False))).alias("_all"))
    rows = tasks.join(kept, "task_id", "left")
    running = F.col("status") == "running"
    cancel = running & (F.col("batch_status") == "cancellation_requested")
    done = running & ~cancel & (F.col("batch_status") == "completed") & F.coalesce("_all", F.lit(False))
    new = F.when(cancel, "cancelled").when(done, "completed").when(running, "interrupted").otherwise(F.col("status"))
    stopped = (~cancel & (new != "completed") & (running | F.col("batch_status").isin(
        "running", "cancellation_requested", "worker_failed")))
    return rows.select(
        *[c for c in tasks.columns if c not in ("status", "batch_status", "progress")],
        new.alias("status"),
        F.when(cancel, "cancelled").when(stopped, "interrupted").otherwise(F.col("batch_status")).alias("batch_status"),
        F.when(done, 100).otherwise(F.col("progress")).alias("progress"))


def finish_tasks(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of finished runs.  ``results``: task_id, successful, total, cancelled, closing."""
    rows = tasks.join(results, "task_id", "left")
    all_ok = F.col("successful") == F.col("total")
    outcome = (F.when(F.col("successful").isNull(), F.col("status")).when(all_ok, "completed")
               .when(F.col("closing"), "interrupted").when(F.col("cancelled"), "cancelled").otherwise("failed"))
    return (rows.withColumn("progress", F.when(F.coalesce(all_ok, F.lit(False)), 100).otherwise(F.col("progress")))
            .withColumn("status", outcome).drop("successful", "total", "cancelled", "closing"))


def requeue_tasks(tasks: DataFrame) -> DataFrame:
    """Put chosen tasks back in the queue, but for running and completed ones."""
    again = ~F.col("status").isin("running", "completed")
    return (tasks.withColumn("_again", again).withColumn("status", F.when(F.col("_again"), "queued").otherwise(F.col("status")))
            .withColumn("batch_status", F.when(F.col("_again"), "queued").otherwise(F.col("batch_status")))
            .withColumn("progress", F.when(F.col("_again"), 0).otherwise(F.col("progress"))).drop("_again"))


def clear_finished(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.col("status").isin(TERMINAL))


def repair_task_ids(tasks: DataFrame) -> DataFrame:
    """Give repeated ids a new one: ``id__recovered_2``, ``_3`` ...; the repeats are failed tasks.

    Numbers already used as literal ids are skipped.
    """
    seen = o.ordered_scan(tasks, ["task_id"], ["ord"], o.every("ord", 50000), _n=o.row_number())
    repeats = seen.filter("_n > 1").select("task_id", "ord", (F.col("_n") - 1).alias("k"))
    stem = "^(.*)__recovered_([1-9][0-9]*)$"
    used = (tasks.select(F.regexp_extract("task_id", stem, 1).alias("task_id"),
                         F.regexp_extract("task_id", stem, 2).try_cast("bigint").alias("number"))
            .filter("number >= 2").distinct())
    free = _free_numbers(repeats.withColumn("k", F.col("k") + 1), used, ["task_id"], ["ord"])
    fixed = seen.join(free.withColumnRenamed("number", "_free"), ["task_id", "ord"], "left")
    repaired = F.col("_free").isNotNull()
    return (fixed.withColumn("repaired", repaired)
            .withColumn("task_id", F.when(repaired, F.concat("task_id", F.lit("__recovered_"), F.col("_free").cast("string")))
                        .otherwise(F.col("task_id")))
            .withColumn("status", F.when(repaired, "failed").otherwise(F.col("status"))).drop("_n", "_free"))


def _free_numbers(wanted: DataFrame, used: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """The k-th number not in ``used``, for each row of ``wanted`` (column ``k``).

    With the used numbers e1 < e2 < ... the k-th free one is k plus the count of
    j with e(j) - j < k; used numbers and requests share one axis, so it takes a
    running count and no loop.  Numbers below the first request's k are never used.
    """
    first = 1
    ranked = o.ordered_scan(used, keys, ["number"], o.every("number", 50000), _j=o.row_number())
    marks = ranked.select(*keys, (F.col("number") - F.col("_j")).alias("_pos"), F.lit(0).alias("_kind"), F.lit(1).alias("_e"))
    # numbers start at 2 for repeated ids and at 1 for names: k counts in the same way
    asked = wanted.select(*keys, *carry, F.col("k").alias("k"), (F.col("k") - first).alias("_pos"), F.lit(1).alias("_kind"),
                          F.lit(0).alias("_e"))
    line = asked.unionByName(marks, allowMissingColumns=True)
    counted = o.ordered_scan(line, keys, ["_pos", "_kind"], o.every("_pos", 50000), _skip=o.running_sum(F.col("_e")))
    return counted.filter("_kind = 1").select(*keys, *carry, (F.col("k") + F.col("_skip")).alias("number"))


def assign_unique_names(requests: DataFrame, existing: DataFrame, suffix: str = "_TR", ext: str = ".mp4") -> DataFrame:
    """Names that clash with nothing: base, base_2, base_3 ...

    ``requests``: folder, base, ord.  ``existing``: folder, name.
    """
    # number 1 is the plain name; what exists is read back as (base, number)
    stem = rf"^(.*){suffix}(?:_([1-9][0-9]*))?{ext.replace('.', '[.]')}$"
    found = existing.select(
        "folder", F.regexp_extract("name", stem, 1).alias("base"), F.regexp_extract("name", stem, 2).alias("_s")).filter(
        F.col("name").rlike(stem) & (F.col("_s") != "1"))
    used = found.select("folder", "base", F.when(F.col("_s") == "", 1).otherwise(F.col("_s").try_cast("bigint"))
                        .cast("bigint").alias("number")).filter("number IS NOT NULL").distinct()
    named = requests.withColumn("base", F.when(F.trim("base") == "", "video").otherwise(F.trim("base")))
    asked = o.ordered_scan(named, ["folder", "base"], ["ord"], o.every("ord", 50000), k=o.row_number())
    free = _free_numbers(asked, used, ["folder", "base"], ["ord"])
    tail = F.when(F.col("number") > 1, F.concat(F.lit("_"), F.col("number").cast("string"))).otherwise("")
    return free.withColumn("output_name", F.concat("base", F.lit(suffix), tail, F.lit(ext))).drop("number")


# ---------------------------------------------------------------- inputs and resume
def _changed(size: Column, modified: Column, now_size: Column, now_modified: Column, readable: Column) -> Column:
    return (F.when(~readable, True).when(size.isNull(), False)
            .otherwise(F.coalesce(size != now_size, F.lit(True)) | F.coalesce(modified != now_modified, F.lit(True))))


def input_changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Whether an input differs from what was recorded.

    ``stored``: input_path, size, modified, readable (False = damaged record).
    ``current``: input_path, size, modified, one row per existing path.
    """
    now = current.select("input_path", F.col("size").alias("_size"), F.col("modified").alias("_mod"))
    return stored.join(now, "input_path", "left").withColumn("changed", _changed(
        F.col("size"), F.col("modified"), F.coalesce("_size", F.lit(-1)), F.coalesce("_mod", F.lit(-2)),
        F.coalesce("readable", F.lit(True)))).drop("_size", "_mod")


def resume_plan(files: DataFrame, inventory: DataFrame, validated: DataFrame) -> DataFrame:
    """What to do with each file of an interrupted batch.

    ``inventory``: input_path, size, modified of existing inputs.
    ``validated``: output_path of outputs that passed validation.
    ``files`` may have ``readable``: False where the stored size or time is no number,
    which counts as changed.
    """
    readable = F.coalesce("readable", F.lit(True)) if "readable" in files.columns else F.lit(True)
    now = inventory.select("input_path", F.col("size").alias("_size"), F.col("modified").alias("_mod"), F.lit(True).alias("_in"))
    good = validated.select("output_path").distinct().withColumn("_good", F.lit(True))
    # files without an output do not meet at one empty key
    key = F.when(F.coalesce("output_path", F.lit("")) == "", F.concat(F.lit("\0"), F.xxhash64("input_path").cast("string"))).otherwise(F.col("output_path"))
    rows = files.withColumn("_key", key).join(now, "input_path", "left").join(good.withColumnRenamed("output_path", "_key"), "_key", "left").drop("_key")
    exists, ok = F.coalesce("_in", F.lit(False)), F.coalesce("_good", F.lit(False)) & (F.col("output_path") != "")
    changed = exists & _changed(F.col("size"), F.col("modified"), F.col("_size"), F.col("_mod"), readable)
    succeeded = F.col("status") == "succeeded"
    action = (F.when(succeeded & ok & ~changed, "keep").when(~exists, "missing")
              .when(succeeded & changed, "redo").when(succeeded, "redo")
              .when(ok & ~changed, "recovered").otherwise("process"))
    reason = (F.when(F.col("action") == "missing", "input_not_available")
              .when(F.col("action") == "redo", F.when(changed, "source_changed").otherwise("output_lost"))
              .when((F.col("action") == "process") & changed, "source_changed").otherwise(""))
    return rows.withColumn("action", action).withColumn("reason", reason).drop("_size", "_mod", "_in", "_good")


def files_to_redo(files: DataFrame, lost: DataFrame) -> DataFrame:
    """Unfinished files, and finished ones whose output is in ``lost`` (output_path)."""
    # files without an output share one key: it is dealt out, and the one lost row of that key is there for every part
    parts = 64
    gone = lost.select("output_path").distinct().withColumn("_part", F.explode(F.when(F.col("output_path") == "", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    part = F.when(F.col("output_path") == "", F.pmod(F.xxhash64(*files.columns), F.lit(parts)).cast("int")).otherwise(0)
    kept = files.withColumn("_part", part).join(gone.withColumn("_lost", F.lit(True)), ["output_path", "_part"], "left").filter(
        (F.coalesce("status", F.lit("pending")) != "succeeded") | F.coalesce("_lost", F.lit(False)))
    return kept.select(*files.columns)


def drop_tombstoned(tasks: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Recovered tasks whose id was already known stay away.  ``known_ids``: task_id."""
    return tasks.join(known_ids.select("task_id"), "task_id", "left_anti")


def dedupe_keep_first(df: DataFrame, key: str, ord: str) -> DataFrame:
    """The first row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), ord).alias("_r")).select(key, "_r.*")


def fork_changed_batches(batches: DataFrame, files: DataFrame, new_settings: DataFrame) -> DataFrame:
    """Files to process when a batch is resumed, under the same or a new batch id.

    Same settings resume the batch; changed ones start ``<id>_new`` with the
    remaining files and no output references.  ``batches``: batch_id, settings
    (canonical JSON).  ``new_settings``: batch_id, new_settings.
    """
    plan = batches.join(new_settings, "batch_id", "left").select("batch_id", F.col("settings").eqNullSafe(
        F.col("new_settings")).alias("_same"))
    rows = files.filter(F.coalesce("status", F.lit("pending")) != "succeeded").join(plan, "batch_id")
    return (rows.withColumn("batch_action", F.when(F.col("_same"), "resume").otherwise("fork"))
            .withColumn("output_path", F.when(F.col("_same"), F.col("output_path")).otherwise(""))
            .withColumn("batch_id", F.when(F.col("_same"), F.col("batch_id").cast("string")).otherwise(
                F.concat(F.col("batch_id").cast("string"), F.lit("_new")))).drop("_same"))


def reconstruct_batches(events: DataFrame) -> DataFrame:
    """Batch files as the log of a lost session tells them; the last event of each kind wins.

    Events carry files (list on batch_started), output_dir, input_path, output_path,
    final_path, success, elapsed_sec, successful, total.  Columns: session_id,
    batch_id, file_index, input_path, status, output_path, elapsed_sec, last_error,
    batch_status.
    """
    def path(c):
        return F.lower(F.regexp_replace(c, r"[\\/]+", "/"))

    began = events.filter("event = 'batch_started'").groupBy("session_id").agg(
        F.max_by(F.struct("files", "output_dir"), "sequence").alias("b"))
    began = began.filter((F.size("b.files") > 0) & (F.coalesce("b.output_dir", F.lit("")) != ""))
    planned = began.select("session_id", F.posexplode(F.filter("b.files", lambda f: f != "")).alias("_p", "input_path")).select(
        "session_id", (F.col("_p") + 1).alias("file_index"), "input_path", path("input_path").alias("_path"))
    told = events.filter(F.col("event").isin("batch_file_started", "batch_file_finished", "file_pipeline_finished")
                         & (F.coalesce("input_path", F.lit("")) != ""))
    finish = F.col("event") == "batch_file_finished"
    state = F.when(F.col("event") == "batch_file_started", "pending").when(
        finish, F.when(F.coalesce("success", F.lit(False)), "succeeded").otherwise("failed"))
    output = F.when(F.col("event") == "batch_file_started", F.col("output_path")).when(
        F.col("event") == "file_pipeline_finished", F.col("final_path"))
    last = told.groupBy("session_id", path("input_path").alias("_path")).agg(
        F.max_by(state, F.when(state.isNotNull(), F.col("sequence"))).alias("status"),
        F.max_by(output, F.when(F.coalesce(output, F.lit("")) != "", F.col("sequence"))).alias("output_path"),
        F.max_by("elapsed_sec", F.when(finish, F.col("sequence"))).alias("elapsed_sec"),
        F.max(F.when(finish & ~F.coalesce("success", F.lit(False)), 1)).alias("_failed"))
    ended = events.filter("event = 'batch_finished'").groupBy("session_id").agg(
        F.max_by(F.struct("successful", "total"), "sequence").alias("e"))
    sizes = planned.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = planned.join(last, ["session_id", "_path"], "left").join(ended, "session_id", "left").join(sizes, "session_id")
    complete = F.col("e").isNotNull() & (F.coalesce("e.successful", F.lit(0)) == F.coalesce(F.nullif("e.total", F.lit(0)), "_n"))
    return rows.select(
        "session_id", F.concat(F.lit("recovered_"), F.col("session_id").cast("string")).alias("batch_id"), "file_index", "input_path",
        F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("output_path", F.lit("")).alias("output_path"),
        F.coalesce("elapsed_sec", F.lit(0.0)).alias("elapsed_sec"),
        F.when(F.col("_failed") == 1, "not finished in the earlier session").otherwise("").alias("last_error"),
        F.when(complete, "completed").otherwise("interrupted").alias("batch_status"))


# ---------------------------------------------------------------- roll-ups
def batch_rollup(files: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """File counts and status per task.  ``cancelled``: task_id of batches a person stopped."""
    counts = files.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "succeeded").alias("successful"),
        F.count_if(F.col("status").isin("failed", "missing")).alias("failed"),
        F.count_if(F.col("status") != "succeeded").alias("pending"))
    stop = F.lit(False)
    if cancelled is not None:
        counts = counts.join(cancelled.select("task_id", F.lit(True).alias("_c")).distinct(), "task_id", "left")
        stop = F.coalesce("_c", F.lit(False))
    status = F.when(stop, "cancelled").when(F.col("successful") == F.col("total"), "completed").otherwise("completed_with_errors")
    return counts.withColumn("status", status).drop("_c")


def _label(status: Column, labels: dict[str, str]) -> Column:
    out = F.when(status == "", F.lit("—")).otherwise(status)
    for word, label in labels.items():
        out = F.when(status == word, F.lit(label)).otherwise(out)
    return out


def task_snapshot(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Display row per task.  Tasks add created_at."""
    counts = files.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("files_total"), F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status").isin("failed", "missing")).alias("failed"),
        F.count_if(F.col("status") == "processing").alias("processing"))
    rows = normalize_tasks(tasks).join(counts, "task_id", "left").fillna(0, ["files_total", "succeeded", "failed", "processing"])
    return rows.select("task_id", "status", _label(F.col("status"), TASK_LABELS).alias("status_label"), "progress",
                       "files_total", "succeeded", "failed", "processing", fmt_clock("created_at").alias("created_at"))


def file_snapshot(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Display row per file.  Tasks add current_file (a file name)."""
    rows = files.join(tasks.select("task_id", "current_file"), "task_id", "left")
    name, out = F.regexp_extract("input_path", r"([^/\\]*)$", 1), F.regexp_extract("output_path", r"([^/\\]*)$", 1)
    current = (F.col("status") == "processing") | ((F.coalesce("current_file", F.lit("")) != "") & (name == F.col("current_file")))
    return rows.select("task_id", "file_index", "status", _label(F.col("status"), FILE_LABELS).alias("status_label"),
                       F.when(name == "", "<no path>").otherwise(name).alias("input_name"),
                       F.when(out == "", "—").otherwise(out).alias("output_name"),
                       fmt_elapsed("elapsed_sec").alias("elapsed"), F.coalesce(current, F.lit(False)).alias("is_current"))
