"""Media streams: default stream, expected durations, output validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite


def default_stream(streams: DataFrame) -> DataFrame:
    """One stream per media and kind: the first flagged default, else the first.

    Input: media_id, kind, index, is_default, attached_pic and any others.
    Cover pictures are not video.
    """
    usable = streams.filter(F.col("kind").isin("video", "audio")
                            & ~((F.col("kind") == "video") & F.coalesce("attached_pic", F.lit(False))))
    place = F.struct(~F.coalesce("is_default", F.lit(False)), F.col("index"))
    rest = [c for c in streams.columns if c not in ("media_id", "kind")]
    return (usable.groupBy("media_id", "kind").agg(F.min_by(F.struct(*rest), place).alias("s"))
            .select("media_id", "kind", "s.*"))


def attach_expected(streams: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected duration per stream: its kind's own value, else the shared one.

    ``expected``: media_id, video_expected, audio_expected, shared_expected.
    """
    own = F.when(F.col("kind") == "video", finite("video_expected")).otherwise(finite("audio_expected"))
    return (streams.join(expected, "media_id", "left")
            .withColumn("expected_duration", F.coalesce(own, finite("shared_expected")))
            .drop("video_expected", "audio_expected", "shared_expected"))


def _failure(expected: Column, start: Column, duration: Column, tolerance: Column) -> Column:
    end = start + duration
    return (F.when(expected.isNull(), F.lit(None).cast("string"))
            .when(expected <= 0, "invalid_expected_duration")
            .when(duration.isNull() | (duration <= 0) | start.isNull(), "invalid_stream_timing")
            .when(F.abs(start) > tolerance, "unexpected_start_time")
            .when(F.abs(end - expected) > tolerance, "duration_mismatch"))


def validate_media(files: DataFrame, streams: DataFrame, expected: DataFrame, tolerance: float = 0.12,
                   min_size: int = 1000) -> DataFrame:
    """Verdict per output file; the first failing stream, video before audio, names the reason.

    ``files``: media_id, size (NULL = missing).  ``streams`` as for :func:`default_stream`,
    with start_time, duration, fps.
    """
    chosen = attach_expected(default_stream(streams), expected)
    fps = finite("fps")
    limit = F.when((F.col("kind") == "video") & (fps > 0), F.greatest(F.lit(tolerance), 1 / fps)).otherwise(tolerance)
    start = F.coalesce(finite("start_time"), F.lit(0.0))
    checked = chosen.withColumn("_fail", _failure(F.col("expected_duration"), start, finite("duration"), limit))
    per_file = checked.groupBy("media_id").agg(
        F.count_if(F.col("kind") == "video").alias("_v"), F.count_if(F.col("kind") == "audio").alias("_a"),
        F.max(F.when(F.col("kind") == "video", F.col("_fail"))).alias("_vf"),
        F.max(F.when(F.col("kind") == "audio", F.col("_fail"))).alias("_af"))
    reason = (F.when(F.coalesce(F.col("size"), F.lit(0)) < min_size, "output_missing_or_too_small")
              .when((F.coalesce("_v", F.lit(0)) == 0) | (F.coalesce("_a", F.lit(0)) == 0),
                    "missing_video_or_audio_stream")
              .when(F.col("_vf").isNotNull(), F.concat(F.lit("video_"), F.col("_vf")))
              .when(F.col("_af").isNotNull(), F.concat(F.lit("audio_"), F.col("_af")))
              .otherwise("ok"))
    return (files.join(per_file, "media_id", "left").withColumn("reason", reason)
            .select("media_id", "size", (F.col("reason") == "ok").alias("valid"), "reason"))
