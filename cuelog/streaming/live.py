"""Streaming intake and aggregations; each works on a stream and on a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.readers import log_lines, parse_event_lines


def stream_event_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Events from rotated log files that appear under ``path``, in the layouts that :func:`read_event_log` knows.

    The file source reads a file once, so a log must be rotated, not appended to.
    """
    lines = (spark.readStream.schema("value STRING").option("maxFilesPerTrigger", max_files)
             .option("recursiveFileLookup", "true").format("text").load(path))
    return parse_event_lines(log_lines(lines))


def live_summary(events: DataFrame) -> DataFrame:
    """Current state of every session; in update mode on a stream, the end state on a table."""
    at = F.col("sequence")
    stage = F.when(F.col("event") == "app_session_finished", "closed").otherwise(F.nullif("stage", F.lit("")))
    path = F.nullif("input_path", F.lit(""))
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.max_by("event", at).alias("last_event"), F.max(at).alias("last_sequence"),
        F.coalesce(F.max_by(stage, F.when(stage.isNotNull(), at)), F.lit("startup")).alias("stage"),
        F.max_by(path, F.when(path.isNotNull(), at)).alias("input_path"),
        F.count_if(F.col("event") == "network_storm_started").alias("incidents_started"),
        F.count_if(F.col("event") == "network_storm_finished").alias("incidents_finished"),
        F.coalesce(F.bool_or(F.col("event") == "app_session_finished"), F.lit(False)).alias("closed"))


def voice_status(events: DataFrame) -> DataFrame:
    """Which voice a session speaks with.  Input adds voice, fallback_count, voice_consistency."""
    event, at = F.col("event"), F.col("sequence")
    restored = (event == "tts_voice_preservation_recovered") | (
        (event == "network_storm_finished") & (F.col("service") == "edge_tts"))
    status = (F.when(event == "file_pipeline_started", "idle").when(event == "tts_voice_preservation_started", "waiting_for_edge_tts")
              .when(event == "tts_edge_probe_started", "checking_edge_tts").when(restored, "selected_voice_restored")
              .when(event == "tts_gtts_fallback_enabled", "gtts_fallback")
              .when(event == "tts_summary", F.coalesce("voice_consistency", F.lit("finished"))))
    fallback = (F.when(event.isin("file_pipeline_started", "tts_voice_preservation_started"), "")
                .when(event == "tts_gtts_fallback_enabled", "gtts")
                .when(event == "tts_summary", F.when(F.coalesce("fallback_count", F.lit(0)) > 0, "gtts").otherwise("")))
    # a new file or a preserved voice sets the voice even where it names none
    voice = (F.when(event.isin("file_pipeline_started", "tts_voice_preservation_started"), F.coalesce("voice", F.lit("")))
             .when(event.isin("tts_gtts_fallback_enabled", "tts_summary"), F.nullif("voice", F.lit(""))))
    last = events.groupBy("session_id").agg(*[
        F.coalesce(F.max_by(value, F.when(value.isNotNull(), at)), F.lit(default)).alias(name)
        for name, value, default in (("status", status, "idle"), ("fallback_provider", fallback, ""), ("selected_voice", voice, ""))])
    return last.withColumn("voice_may_differ", F.col("fallback_provider") != "")


def windowed_failures(calls: DataFrame, window: str = "10 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Failures per service and time window; rows later than the watermark are dropped on a stream.

    Input: service, ts, kind.  The watermark follows the failures, the rows that are counted.  Counting
    starts on the map side, so one busy service costs no more than its windows.
    """
    rows = calls.withWatermark("ts", watermark) if calls.isStreaming and watermark else calls
    return (rows.filter("kind = 'failure'").groupBy(F.window("ts", window).alias("w"), "service")
            .agg(F.count(F.lit(1)).alias("failures")).select(
                F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "service", "failures"))


def failure_sessions(calls: DataFrame, gap: str = "10 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Stretches of failures per service with no pause of ``gap`` in between: their first and last moment plus ``gap``, and how many.

    Input: service, ts, kind.  On a stream a stretch is told once the watermark has passed its end; failures
    of one stretch that come in different triggers are merged in the state.
    """
    rows = calls.withWatermark("ts", watermark) if calls.isStreaming and watermark else calls
    return (rows.filter("kind = 'failure'").groupBy(F.session_window("ts", gap).alias("w"), "service")
            .agg(F.count(F.lit(1)).alias("failures")).select(
                F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "service", "failures"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything present and return what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over everything present and return the last row of every key.

    Each trigger's rows are written under its number, so a trigger that is run again writes the same files.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/_trigger={number}")

    query = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).foreachBatch(keep).start())
    query.awaitTermination()
    seen = spark.read.option("basePath", f"{base}/rows").schema(f"{_ddl(stream)}, _trigger INT").parquet(f"{base}/rows/_trigger=*")
    last = seen.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_trigger").alias("r"))
    return last.select("r.*")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def intake(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Take in what is new under ``path`` since the last call with this ``base``; all events taken in so far.

    ``base`` (in the shared folder) holds the progress and the events: a call after a crash or a restart goes
    on where the last finished trigger stopped, and no file counts twice.
    """
    stream = stream_event_log(spark, path)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
