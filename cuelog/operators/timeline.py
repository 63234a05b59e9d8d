"""Timelines: tempo, placement, pauses, shifted times and mix groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..functions.greedy import island_groups
from ..functions.numbers import edge_rate, finite, round_exact
from ..session import cut_lineage
from .segments import HOUR, KEY, ORDER, speech_boundaries

MIN_PAUSE = 0.035
FINISH_MARGIN = 0.055


def tempo_plan(slots: DataFrame, durations: DataFrame, speed_limit: float = 1.15,
               max_tempo: float = 1.25) -> DataFrame:
    """Speed-up per phrase from measured durations.

    ``durations``: media_id, ord, base_dur, native_dur (at the native rate, or NULL).
    The duration after stretching is computed, not measured.
    """
    rows = slots.join(durations, ["media_id", "ord"])
    base = finite("base_dur")
    needed = F.when(F.col("target_slot") > 0, F.col("base_dur") / F.col("target_slot")).otherwise(1.0)
    rate = edge_rate(F.least(needed, F.lit(speed_limit)), speed_limit)
    native = finite("native_dur")
    rows = (rows.filter(base.isNotNull() & (base > 0)).withColumn("_rate", rate)
            .withColumn("_use", F.coalesce(
                (F.col("_rate") > 0) & (native > 0) & (native < F.col("base_dur") * 0.995), F.lit(False)))
            .withColumn("native_rate", F.when(F.col("_use"), F.col("_rate")).otherwise(0))
            .withColumn("_cur", F.when(F.col("_use"), F.col("native_dur")).otherwise(F.col("base_dur"))))
    reached = F.greatest(F.lit(1.0), F.col("base_dur") / F.col("_cur"))
    cap = F.greatest(F.lit(1.0), F.lit(speed_limit) / reached)
    now = F.when(F.col("target_slot") > 0, F.col("_cur") / F.col("target_slot")).otherwise(1.0)
    tempo = F.least(now, cap, F.lit(max_tempo))
    rows = rows.withColumn("tempo", F.when((now > 1.025) & (cap > 1.025) & (tempo > 1.025), tempo).otherwise(1.0))
    return (rows.withColumn("final_dur", F.col("_cur") / F.col("tempo"))
            .withColumn("total_speed", F.greatest(F.lit(1.0), F.col("base_dur") / F.col("final_dur")))
            .withColumn("video_pause_needed", F.col("final_dur") > F.col("hard_slot") + MIN_PAUSE)
            .drop("_rate", "_use", "_cur"))


def place_timeline(slots: DataFrame, durations: DataFrame, media: DataFrame) -> DataFrame:
    """Start delay of each phrase and the pause it needs; rows without audio add nothing.

    ``durations``: media_id, ord, tts_dur.
    """
    rows = (slots.join(durations.select("media_id", "ord", "tts_dur"), ["media_id", "ord"])
            .filter(F.col("tts_dur").isNotNull()))
    extra = F.greatest(F.lit(0.0), F.col("tts_dur") + FINISH_MARGIN - F.col("hard_slot"))
    rows = rows.withColumn("pause_extra", F.when(extra >= MIN_PAUSE, extra).otherwise(0.0))
    placed = o.ordered_scan(rows, KEY, ORDER, o.every("start", HOUR), _shift=o.sum_before(F.col("pause_extra")))
    return (placed.join(media.select("media_id", "video_dur"), "media_id", "left")
            .withColumn("shifted_start", F.col("start") + F.col("_shift"))
            .withColumn("delay_ms", F.floor(F.greatest(F.lit(0.0), F.col("shifted_start")) * 1000).cast("bigint"))
            .withColumn("freeze_at", F.when(F.col("pause_extra") > 0, F.least(
                F.col("video_dur"), F.col("start") + F.col("hard_slot"))))
            .drop("_shift", "video_dur"))


def pauses_of(placed: DataFrame) -> DataFrame:
    """The pauses a placed timeline asks for: media_id, ord, at, duration, segments, natural_gap_used."""
    return placed.filter(F.col("pause_extra") > 0).select(
        "media_id", "ord", F.col("freeze_at").alias("at"), F.col("pause_extra").alias("duration"),
        F.array(F.col("ord").cast("bigint")).alias("segments"),
        F.greatest(F.lit(0.0), F.col("hard_slot") - F.col("spoken_slot")).alias("natural_gap_used"))


def sanitize_pauses(pauses: DataFrame, media: DataFrame, within: float = 0.020) -> DataFrame:
    """Clamp positions, drop micro pauses, join pauses closer than ``within`` to the
    first of their group.  Input: media_id, ord, at, duration, segments."""
    at = F.greatest(F.lit(0.0), F.least(F.coalesce("video_dur", F.lit(0.0)), F.col("at")))
    clean = (pauses.join(media.select("media_id", "video_dur"), "media_id", "left")
             .filter(F.col("duration") >= MIN_PAUSE)
             .select("media_id", at.alias("pos"), F.col("at").alias("raw"), "ord", "duration", "segments"))
    # one row per position first, so that many pauses on one spot stay cheap
    spots = clean.groupBy("media_id", "pos").agg(
        F.sum("duration").alias("duration"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("raw", "ord", "segments"))),
                              lambda p: p["segments"])).alias("segments"))

    grouped = island_groups(spots, KEY, ["pos"], o.every("pos", HOUR), o.previous(F.col("pos")), lambda before: F.col("pos") - before >= within,
                            ["pos"], lambda pos: (pos,), lambda state, pos: state if abs(state[0] - pos) < within else None)
    parts = F.array_sort(F.collect_list(F.struct("position", "segments")))
    return grouped.groupBy("media_id", "group_start").agg(
        F.min("pos").alias("at"), F.sum("duration").alias("duration"),
        F.flatten(F.transform(parts, lambda p: p["segments"])).alias("segments"),
    ).select("media_id", F.col("group_start").alias("ord"), "at", "duration", "segments")


def has_boundary_between(pauses: DataFrame, boundaries: DataFrame, eps: float = 0.001) -> DataFrame:
    """Flag intervals (``left``, ``right``) with a boundary strictly inside.

    No range join: intervals and boundaries share one order axis and each
    interval looks up the next boundary after its left end.
    """
    fields = pauses.columns
    asked = pauses.select("media_id", (F.col("left") + eps).alias("_pos"), F.lit(1).alias("_kind"),
                          F.lit(None).cast("double").alias("_b"), F.struct(*fields).alias("_row"))
    marks = boundaries.select("media_id", F.col("boundary").alias("_pos"), F.lit(0).alias("_kind"),
                              F.col("boundary").alias("_b"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    line = o.ordered_scan(asked.unionByName(marks), KEY, ["_pos", "_kind"], o.every("_pos", HOUR),
                          _next=o.next_known(F.col("_b")))
    return line.filter("_kind = 1").select("_row.*", F.coalesce(
        F.col("_next") < F.col("_row.right") - eps, F.lit(False)).alias("boundary_between"))


def merge_nearby_pauses(pauses: DataFrame, segments: DataFrame, media: DataFrame,
                        max_distance: float = 0.30) -> DataFrame:
    """Join pauses at most ``max_distance`` apart with no speech boundary between them."""
    clean = sanitize_pauses(pauses, media)
    # pauses and boundaries on one axis: each pause sees the pause and the boundary before it
    eps = 0.001
    stops = clean.select("media_id", (F.col("at") - eps).alias("_pos"), F.lit(0).alias("_kind"),
                         F.lit(None).cast("double").alias("_b"), "at", "duration", "segments")
    marks = speech_boundaries(segments).select("media_id", F.col("boundary").alias("_pos"), F.lit(1).alias("_kind"),
                                               F.col("boundary").alias("_b"))
    line = stops.unionByName(marks, allowMissingColumns=True).withColumn("_hour", o.every("_pos", HOUR))
    seen = o.ordered_scan(line, KEY, ["_pos", "_kind"], "_hour", _left=o.known_before(F.col("at")),
                          _mark=o.known_before(F.col("_b")))
    joinable = (F.col("at") - F.col("_left") <= max_distance) & ~F.coalesce(
        F.col("_mark") > F.col("_left") + eps, F.lit(False))
    fresh = cut_lineage(seen.filter("_kind = 0").withColumn("_new", F.when(F.coalesce(joinable, F.lit(False)), 0)
                                                            .otherwise(1).cast("bigint")))
    grouped = o.ordered_scan(fresh, KEY, ["at"], "_hour", _g=o.running_sum(F.col("_new")))
    parts = F.array_sort(F.collect_list(F.struct("at", "segments")))
    merged = grouped.groupBy("media_id", F.col("_g").alias("ord")).agg(
        F.max("at").alias("at"), F.sum("duration").alias("duration"),
        F.flatten(F.transform(parts, lambda p: p["segments"])).alias("segments"))
    return sanitize_pauses(merged, media)


def shift_by_pauses(points: DataFrame, pauses: DataFrame, time_col: str) -> DataFrame:
    """Time on the output timeline: plus all pauses at or before the point."""
    fields = points.columns
    value = F.greatest(F.lit(0.0), F.coalesce(F.col(time_col), F.lit(0.0)))
    asked = points.select("media_id", (value + 1e-6).alias("_pos"), F.lit(1).alias("_kind"),
                          F.lit(0.0).alias("_d"), F.struct(*fields).alias("_row"))
    stops = pauses.select("media_id", F.col("at").alias("_pos"), F.lit(0).alias("_kind"),
                          F.greatest(F.lit(0.0), F.col("duration")).alias("_d"),
                          F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    line = o.ordered_scan(asked.unionByName(stops), KEY, ["_pos", "_kind"], o.every("_pos", HOUR),
                          _extra=o.running_sum(F.col("_d")))
    moved = F.greatest(F.lit(0.0), F.coalesce(F.col(f"_row.{time_col}"), F.lit(0.0))) + F.col("_extra")
    return line.filter("_kind = 1").select("_row.*", moved.alias("shifted"))


def pause_summary(raw: DataFrame, merged: DataFrame, media: DataFrame, severe_sec: float = 2.0) -> DataFrame:
    """Pause counts and totals per media; ``raw`` and ``merged`` are sanitized plans."""
    before = raw.groupBy("media_id").agg(F.count(F.lit(1)).alias("before"))
    after = merged.groupBy("media_id").agg(
        # added up as decimals, so the order of the rows cannot show in a last digit
        F.count(F.lit(1)).alias("pause_count"), F.sum(F.col("duration").cast("decimal(28,12)")).cast("double").alias("_total"), F.max("duration").alias("_max"),
        F.count_if(F.col("duration") >= severe_sec).alias("severe_pause_count"))
    rows = media.select("media_id", "video_dur").join(before, "media_id", "left").join(after, "media_id", "left")
    rows = rows.fillna(0, ["before", "pause_count", "_total", "_max", "severe_pause_count"])
    return rows.select(
        "media_id", "before", "pause_count",
        F.greatest(F.lit(0), F.col("before") - F.col("pause_count")).alias("merged"),
        round_exact("_total", 3).alias("total_pause_sec"),
        round_exact(F.when(F.col("video_dur") > 0, F.col("_total") / F.col("video_dur")).otherwise(0.0), 5).alias("pause_ratio"),
        "severe_pause_count", round_exact("_max", 3).alias("max_pause_sec"))


def top_pauses(pauses: DataFrame, min_sec: float = 2.0, k: int = 10) -> DataFrame:
    """The ``k`` longest pauses of at least ``min_sec`` per media."""
    order = Window.partitionBy("media_id").orderBy(F.desc("duration"), "at")
    return (pauses.filter(F.col("duration") >= min_sec).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))


def quantize_pauses(pauses: DataFrame, media_fps: DataFrame) -> DataFrame:
    """Pause total as whole video frames; the plain sum where the rate is unknown."""
    fps = F.when(finite("fps") > 0, F.col("fps"))
    duration = F.greatest(F.lit(0.0), F.col("duration"))
    totals = pauses.join(media_fps.select("media_id", "fps"), "media_id", "left").groupBy("media_id").agg(
        F.max(fps).alias("_fps"), F.sum(duration).alias("_raw"),
        F.sum(F.floor(duration * fps + 0.5)).cast("bigint").alias("frames"))
    return totals.select("media_id", F.coalesce(F.col("frames") / F.col("_fps"), F.col("_raw")).alias("effective_sec"),
                         "frames")


def mix_plan(placed: DataFrame, media: DataFrame, size: int = 20) -> DataFrame:
    """Groups of ``size`` phrases in order with the length each mix needs.

    ``placed``: media_id, start, ord, delay_ms, tts_dur.  The last group, and one
    with an unknown duration, keeps the full length ``final_dur`` of ``media``.
    """
    numbered = o.ordered_scan(placed, KEY, ORDER, o.every("start", HOUR), _n=o.row_number())
    groups = numbered.groupBy("media_id", F.floor((F.col("_n") - 1) / size).cast("bigint").alias("group_no")).agg(
        F.count(F.lit(1)).alias("phrases"), F.max(F.col("delay_ms") / 1000 + F.col("tts_dur")).alias("_end"),
        F.count_if(F.col("tts_dur").isNull()).alias("_unknown"))
    last = groups.groupBy("media_id").agg(F.max("group_no").alias("_last"))
    needed = F.ceil((F.col("_end") + 0.1) * 1000) / 1000
    return (groups.join(last, "media_id").join(media.select("media_id", "final_dur"), "media_id", "left")
            .select("media_id", "group_no", "phrases", F.when(
                (F.col("group_no") < F.col("_last")) & (F.col("_unknown") == 0),
                F.least(F.col("final_dur"), needed)).otherwise(F.col("final_dur")).alias("group_duration")))
