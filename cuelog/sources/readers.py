"""Readers for stored state: checkpoints, logs, sessions, glossaries, queues, probes, inventories.

Schemas are fixed, never inferred.  State files are small and many, one JSON
value per file; logs are JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, strip

# ---- fixed values: stored schemas ----
CHECKPOINT = ("schema_version INT, updated_at STRING, input STRUCT<path STRING, size BIGINT, modified_ns BIGINT>, "
              "source_language STRING, target_language STRING, "
              "segments ARRAY<STRUCT<key STRING, start DOUBLE, `end` DOUBLE, source STRING, translated STRING>>")
EVENT = ("schema_version INT, timestamp STRING, sequence BIGINT, level STRING, event STRING, message STRING, "
         "thread STRING, details VARIANT")
HOT_DETAILS = {
    "stage": "string", "input_path": "string", "service": "string", "component": "string", "provider": "string",
    "elapsed_sec": "double", "output_path": "string", "final_path": "string", "output_dir": "string",
    "success": "boolean", "successful": "int", "total": "int",
}
MANIFEST = "schema_version INT, artifact_type STRING, session_id STRING, status STRING, updated_at STRING"
TASK_FILE = ("file_index STRING, input STRUCT<path: STRING, size: STRING, modified_ns: STRING>, status STRING, "
             "output_path STRING, elapsed_sec STRING, last_error STRING")
TASK = ("task_id STRING, created_at STRING, updated_at STRING, started_at STRING, finished_at STRING, status STRING, "
        "batch_state STRUCT<batch_id: STRING, status: STRING, output_dir: STRING, settings: VARIANT, files: ARRAY<VARIANT>>, "
        "runtime STRUCT<current_file: STRING, file_index: STRING, files_total: STRING, progress: STRING, status_text: STRING>")
QUEUE = "schema_version STRING, known_task_batch_ids VARIANT, tasks ARRAY<VARIANT>"
PROBE = ("format STRUCT<duration STRING>, streams ARRAY<STRUCT<index INT, codec_type STRING, codec_name STRING, "
         "start_time STRING, duration STRING, avg_frame_rate STRING, "
         "disposition STRUCT<`default` INT, attached_pic INT>>>")
SESSION_FOLDER = r"session_[0-9]{8}_[0-9]{6}_[0-9]{6}_[0-9]+"
# ---- end of fixed values ----


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; a byte order mark is not part of its text."""
    return spark.read.text(path, wholetext=True).withColumn("value", F.ltrim("value", F.lit("\ufeff")))


def _file_name() -> Column:
    return F.col("_metadata.file_path")


#: Part files of Spark's text writer hold one checkpoint document a line.
DOCUMENT_LINES = r"/part-[^/]*\.txt$"


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Stored translations: media_id (input path), target, key, start, end, source, translated, ord.

    A file is one document, or, as :func:`writers.write_checkpoints` writes it, a document a line.
    """
    in_lines = _file_name().rlike(DOCUMENT_LINES)
    whole = spark.read.schema(CHECKPOINT).json(path, multiLine=True).filter(~in_lines)
    files = whole.unionByName(spark.read.schema(CHECKPOINT).json(path).filter(in_lines))
    rows = files.filter("schema_version = 1").select(
        F.col("input.path").alias("media_id"), F.col("target_language").alias("target"), "source_language",
        F.posexplode("segments").alias("ord", "s"))
    return rows.select("media_id", "target", "source_language", "ord", "s.*").withColumn(
        "translated", strip("translated")).filter((F.coalesce("key", F.lit("")) != "") & (F.col("translated") != ""))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Log lines (value, session_id, in_lines) as events; lines that are not JSON objects are skipped.

    With ``in_lines`` the line itself names its session.
    """
    record = F.try_parse_json("value")
    rows = lines.withColumn("_j", record).filter(F.schema_of_variant("_j").startswith("OBJECT"))
    own = F.when(F.col("in_lines"), F.try_variant_get("_j", "$.session_id", "string")).otherwise(F.col("session_id"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("_j", f"$.{name}", kind)

    hot = [field(f"details.{k}", t).alias(k) for k, t in HOT_DETAILS.items()]
    exc = [field("details.exception.type", "string").alias("exc_type"),
           field("details.exception.category", "string").alias("exc_category"),
           field("details.exception.message", "string").alias("exc_message"),
           (F.coalesce(field("details.exception.traceback", "string"), F.lit("")) != "").alias("has_traceback"),
           field("details.validation.reason", "string").alias("validation_reason"),
           F.coalesce(field("details.returncode", "string"), field("details.return_code", "string")).alias("returncode"),
           F.coalesce(F.array_join(field("details.command", "array<string>"), " "), field("details.command", "string")).alias("command"),
           F.coalesce(field("details.files", "array<string>"), field("details.files.items", "array<string>")).alias("files")]
    return rows.select(
        own.alias("session_id"), field("schema_version", "int").alias("schema_version"),
        F.try_to_timestamp(field("timestamp", "string")).alias("ts"),
        F.coalesce(field("sequence", "bigint"), F.lit(0)).alias("sequence"),
        F.coalesce(field("level", "string"), F.lit("info")).alias("level"), field("event", "string").alias("event"),
        F.coalesce(field("message", "string"), F.lit("")).alias("message"), *hot, *exc,
        field("details", "variant").alias("details"))


#: A log file or folder of part files, in the folder of its session.
LOG_FILE = r"/(?:session_id=)?([^/]+)/(?:log=)?(?:events|problems)\.jsonl[^/]*(?:/[^/]+)?$"
#: A part file that many sessions share, in the folder of its log.
SHARED_LOG = r"/log=(?:events|problems)\.jsonl/[^/]+$"
SESSION_LOG = r"/session_id=[^/]+/log=[^/]+/[^/]+$"


def log_lines(files: DataFrame) -> DataFrame:
    """The lines of log files: value, session_id (the folder name) and in_lines (the session is named in the line)."""
    name = _file_name()
    return files.filter(name.rlike(LOG_FILE)).select(
        "value", F.regexp_extract(name, LOG_FILE, 1).alias("session_id"), (name.rlike(SHARED_LOG) & ~name.rlike(SESSION_LOG)).alias("in_lines"))


def read_event_log(spark: SparkSession, root: str) -> DataFrame:
    """Both halves of all session logs under ``root``, rotated parts included; the folder name is the session.

    Part files that many sessions share name it in every line.  Other files below ``root`` are listed but not read.
    """
    return parse_event_lines(log_lines(spark.read.option("recursiveFileLookup", "true").text(root)))


def read_sessions(spark: SparkSession, root: str, artifact_type: str, schema_version: int = 1) -> DataFrame:
    """Session folders with a manifest of the given type and version: session_id, status, updated_at."""
    rows = spark.read.schema(MANIFEST).json(f"{root}/*/manifest.json", multiLine=True)
    return rows.withColumn("folder", F.regexp_extract(_file_name(), r"([^/]+)/[^/]+$", 1)).filter(
        F.col("folder").rlike(f"^{SESSION_FOLDER}$") & (F.col("schema_version") == schema_version)
        & (F.col("artifact_type") == artifact_type)).select("folder", "session_id", "status", "updated_at")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary terms: source_term, target_term, ord; blanks collapsed, empty terms dropped."""
    whole = _whole_files(spark, path)
    pairs = whole.select(F.posexplode(F.map_entries(F.from_json("value", T.MapType(T.StringType(), T.StringType())))).alias("ord", "e"))
    return pairs.select(collapse("e.key").alias("source_term"), collapse("e.value").alias("target_term"),
                        F.col("ord").cast("bigint").alias("ord")).filter("source_term <> '' AND target_term <> ''")


def split_corrupt(raw: DataFrame, good: Column, version: Column, expected_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Usable rows and a quarantine with label and raw text.

    ``raw``: value (JSON text) and any others.  ``good``: the parsed value has all it
    needs.  Rows are corrupt (no JSON), unsupported (other version) or partial.
    """
    label = (F.when(F.try_parse_json("value").isNull() | ~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), "corrupt")
             .when(~F.coalesce(version == expected_version, F.lit(False)), "unsupported")
             .when(~F.coalesce(good, F.lit(False)), "partial"))
    rows = raw.withColumn("label", label)
    return rows.filter("label IS NULL").drop("label"), rows.filter("label IS NOT NULL")


def _unreadable(column: str) -> Column:
    """A stored number that is there but is none."""
    return F.col(column).isNotNull() & F.col(column).try_cast("bigint").isNull()


def read_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Task queue files as (tasks, files, known ids), unnormalised; ``ord`` keeps queue order.

    Broken entries are left out; find them with :func:`quarantined_tasks`.
    """
    whole = _whole_files(spark, path)
    queue = whole.select(F.from_json("value", QUEUE).alias("q")).filter(F.col("q.schema_version").try_cast("int") == 1)
    entries = queue.select(F.posexplode("q.tasks").alias("ord", "v")).select(
        F.col("ord").cast("bigint").alias("ord"), F.from_json(F.to_json("v"), TASK).alias("t"))
    batch_id = F.coalesce(F.nullif(F.trim("t.task_id"), F.lit("")), F.trim("t.batch_state.batch_id"))
    usable = entries.filter(F.col("t.batch_state.files").isNotNull() & (F.coalesce(batch_id, F.lit("")) != ""))
    tasks = usable.select(
        batch_id.alias("task_id"), "ord", F.col("t.status").alias("status"), F.col("t.batch_state.status").alias("batch_status"),
        F.col("t.runtime.progress").alias("progress"), F.col("t.runtime.current_file").alias("current_file"),
        F.col("t.created_at").alias("created_at"), F.col("t.finished_at").alias("finished_at"),
        F.to_json("t.batch_state.settings").alias("settings"))
    files = usable.select(batch_id.alias("task_id"), F.posexplode("t.batch_state.files").alias("p", "v")).select(
        "task_id", (F.col("p") + 1).cast("bigint").alias("position"), F.from_json(F.to_json("v"), TASK_FILE).alias("f")).select(
        "task_id", "position", "f.file_index", "f.status", F.col("f.input.path").alias("input_path"), "f.output_path",
        F.col("f.input.size").try_cast("bigint").alias("size"), F.col("f.input.modified_ns").try_cast("bigint").alias("modified"),
        (~(_unreadable("f.input.size") | _unreadable("f.input.modified_ns"))).alias("readable"),
        "f.elapsed_sec", "f.last_error")
    ids = F.coalesce(F.try_variant_get("q.known_task_batch_ids", "$", "array<string>"),
                     F.array(F.try_variant_get("q.known_task_batch_ids", "$", "string")))
    known = queue.select(F.posexplode(ids).alias("ord", "task_id")).select(F.trim("task_id").alias("task_id"), "ord").filter("task_id <> ''")
    return tasks, files, known


def quarantined_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Queue files that cannot be used whole: label (corrupt, unsupported, partial) and raw text."""
    whole = _whole_files(spark, path).select(_file_name().alias("file"), "value")
    queue = F.from_json("value", QUEUE)
    sound = F.forall(F.transform(queue["tasks"], lambda v: F.from_json(F.to_json(v), TASK)), lambda t: (
        t["batch_state"]["files"].isNotNull()
        & (F.coalesce(F.nullif(F.trim(t["task_id"]), F.lit("")), F.trim(t["batch_state"]["batch_id"]), F.lit("")) != "")))
    _, kept = split_corrupt(whole, queue["tasks"].isNotNull() & sound, queue["schema_version"].try_cast("int"))
    return kept


def read_media_probe(spark: SparkSession, path: str) -> DataFrame:
    """Stored probe results, one row per stream: media_id (file), kind, index, times, rate, flags."""
    from ..functions.numbers import finite, frame_rate
    rows = spark.read.schema(PROBE).json(path, multiLine=True).select(
        F.regexp_extract(_file_name(), r"([^/]+)\.json$", 1).alias("media_id"),
        finite("format.duration").alias("format_duration"), F.explode("streams").alias("s"))
    return rows.select(
        "media_id", "format_duration", F.col("s.codec_type").alias("kind"), F.col("s.index").alias("index"),
        F.coalesce("s.codec_name", F.lit("")).alias("codec"), F.coalesce(finite("s.start_time"), F.lit(0.0)).alias("start_time"),
        finite("s.duration").alias("duration"), frame_rate("s.avg_frame_rate").alias("fps"),
        (F.coalesce("s.disposition.default", F.lit(0)) != 0).alias("is_default"),
        (F.coalesce("s.disposition.attached_pic", F.lit(0)) != 0).alias("attached_pic"))


def classify_inventory(listing: DataFrame, root: str) -> DataFrame:
    """A listing (path, size, mtime) as cache files.

    ``kind`` is entry (64-hex name with a known suffix), temporary or other.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = (F.when(name.rlike(r"^\.[0-9a-f]{64}\..*\.tmp$"), "temporary")
            .when(name.rlike(r"^[0-9a-f]{64}\.[^.]+$") & suffix.isin(".mp3", ".wav", ".json"), "entry").otherwise("other"))
    return listing.select(F.lit(root).alias("root"), "path", F.regexp_extract(name, r"^\.?([0-9a-f]{64})", 1).alias("key"),
                          suffix.alias("suffix"), "size", "mtime", kind.alias("kind"))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Cache files under ``root`` by name, size and time; contents are not read.

    Spark's file source leaves out names with a leading dot; to see temporary
    files pass the storage's own listing to :func:`classify_inventory`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return classify_inventory(files, root)
