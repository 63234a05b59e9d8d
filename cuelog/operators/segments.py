"""Timed speech segments: stitching, merging, slots, quality, pacing.

Segments carry ``media_id``, ``ord`` (arrival number), ``start``, ``end``, ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..functions.greedy import island_groups
from ..functions.numbers import round_exact
from ..functions.text import language_base, looks_like_script, lstrip, rstrip, script_chars, strip, word_normalize

KEY = ["media_id"]
ORDER = ["start", "ord"]
HOUR = 3600.0


def nonempty_segments(segments: DataFrame, text_col: str = "text") -> DataFrame:
    """Number all segments from 1, then keep those with text."""
    numbered = o.ordered_scan(segments, KEY, ORDER, o.every("start", HOUR), seg_index=o.row_number())
    return numbered.filter(strip(text_col) != "")


def stitch_chunks(chunk_segments: DataFrame, chunk_sec: float = 30.0) -> DataFrame:
    """Chunk-relative times to media times; segments renumbered from 0.

    Input adds ``chunk`` (from 0) and ``id`` (number inside the chunk).
    """
    offset = F.col("chunk") * F.lit(float(chunk_sec))
    moved = (chunk_segments
             .withColumn("start", F.coalesce(F.col("start"), F.lit(0.0)) + offset)
             .withColumn("end", F.coalesce(F.col("end"), F.lit(0.0)) + offset))
    if "words" in chunk_segments.columns:
        moved = moved.withColumn("words", F.transform("words", lambda w: w.withField(
            "start", w["start"] + offset).withField("end", w["end"] + offset)))
    out = o.ordered_scan(moved, KEY, ["chunk", "id"], o.every("chunk", 100), _n=o.row_number())
    return out.withColumn("id", F.col("_n") - 1).drop("_n")


def detect_language(chunks: DataFrame, stop_langs: list[str] = ("ru",)) -> DataFrame:
    """Language of the first chunk with text and a language; chunks needed for it.

    Input: media_id, chunk, text, language, n_segments.  Reading stops after the
    first chunk that confirms a stop language.
    """
    spoken = strip("text") != ""
    lang = language_base("language")
    known = spoken & (lang != "")
    first = chunks.groupBy("media_id").agg(
        F.min_by(lang, F.when(known, F.col("chunk"))).alias("language"),
        F.min(F.when(known, F.col("chunk"))).alias("_from"),
        F.count(F.lit(1)).alias("_chunks"))
    confirmed = ((F.col("chunk") >= F.col("_from")) & spoken & (F.col("n_segments") > 0)
                 & F.col("d.language").isin(*stop_langs)
                 & ((F.col("d.language") != "ru") | looks_like_script("text")))
    stop = (chunks.select("media_id", "chunk", "text", "n_segments").join(first.alias("d"), "media_id")
            .filter(confirmed).groupBy("media_id").agg(F.min("chunk").alias("_stop")))
    return first.join(stop, "media_id", "left").select(
        "media_id", F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce(F.col("_stop") + 1, F.col("_chunks")).alias("chunks_used"),
        F.col("_stop").isNotNull().alias("early_stop"))


def _mark_runs(segments: DataFrame) -> DataFrame:
    words = segments.withColumn("_norm", word_normalize("text")).withColumn("_hour", o.every("start", HOUR))
    prior = o.ordered_scan(words, KEY, ORDER, "_hour", _prev=o.previous(F.col("_norm")))
    flagged = prior.withColumn("is_repeat", F.coalesce(
        (F.col("_norm") != "") & (F.col("_norm") == F.col("_prev")), F.lit(False)))
    return o.ordered_scan(flagged, KEY, ORDER, "_hour", run_id=o.running_sum(
        F.when(F.col("is_repeat"), 0).otherwise(1).cast("bigint")))


def repeat_runs(segments: DataFrame) -> DataFrame:
    """Runs of neighbours with the same words; empty text never repeats."""
    runs = _mark_runs(segments)
    sizes = runs.groupBy("media_id", "run_id").agg(F.count(F.when(F.col("_norm") != "", 1)).alias("run_len"))
    return runs.drop("_norm", "_prev", "_hour").join(sizes, ["media_id", "run_id"])


def asr_quality(segments: DataFrame, warn_run: int = 3, warn_ratio: float = 0.25) -> DataFrame:
    """Recognition-quality counts per media: summed per run first, then per media."""
    def over(column: str, limit: float):
        value = F.col(column)
        return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))

    low = F.coalesce(~F.isnan("avg_logprob") & (F.col("avg_logprob") < -0.9), F.lit(False))
    dense = over("compression_ratio", 2.4)
    counts = {
        "segments": F.lit(True),
        "word_timed_segments": F.coalesce(F.size("words"), F.lit(0)) > 0,
        "low_logprob_segments": low,
        "high_compression_segments": dense,
        "high_no_speech_segments": over("no_speech_prob", 0.6),
        "temperature_fallback_segments": over("temperature", 0.5),
        "repeated_adjacent_segments": F.col("is_repeat"),
        "_suspicious": low | dense,
        "_run": F.col("_norm") != "",
    }
    runs = _mark_runs(segments).groupBy("media_id", "run_id").agg(
        *[F.count_if(test).alias(name) for name, test in counts.items()])
    ratio = round_exact(F.sum("_suspicious") / F.sum("segments"), 4)
    return runs.groupBy("media_id").agg(
        *[F.sum(name).alias(name) for name in counts if not name.startswith("_")],
        F.max("_run").alias("longest_repeat_run"), ratio.alias("suspicious_ratio"),
    ).withColumn("warn", (F.col("longest_repeat_run") >= warn_run) | (F.col("suspicious_ratio") >= warn_ratio))


def passthrough(segments: DataFrame, target: str = "ru", pattern: str | None = None,
                min_letters: int = 6, min_ratio: float = 0.45) -> DataFrame:
    """Media already in the target language: the label says so and the script agrees.

    Input adds ``language``.  Letters are counted per row and summed, so the text
    of a media is never put together.
    """
    own = script_chars("text", pattern) if pattern else script_chars("text", "[А-Яа-яЁё]")
    return segments.groupBy("media_id").agg(
        F.max(language_base("language")).alias("language"),
        F.sum(script_chars("text", r"\p{L}")).cast("bigint").alias("letters"),
        F.sum(own).cast("bigint").alias("script_letters"),
    ).withColumn("passthrough", (F.col("language") == target) & (F.col("script_letters") >= min_letters)
                 & (F.col("script_letters") >= F.col("letters") * min_ratio))


def merge_short_segments(segments: DataFrame, min_dur: float = 1.2, max_gap: float = 0.38,
                         max_merged: float = 5.8) -> DataFrame:
    """Join a short segment with what follows while the gap and the sum stay small."""
    def begin(start, end):
        return start, end

    def advance(state, start, end):
        first, reach = state
        if max(0.0, reach - first) >= min_dur or max(0.0, start - reach) > max_gap or max(reach, end) - first > max_merged:
            return None
        return first, max(reach, end)

    rows = segments.select("media_id", "ord", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    # no group reaches a row that lies more than the gap after the end of everything before it
    grouped = island_groups(rows, KEY, ORDER, o.every("start", HOUR), o.max_before(F.col("end")),
                            lambda end: F.col("start") - end > max_gap, ["start", "end"], begin, advance)
    pieces = F.array_sort(F.collect_list(F.struct("position", "text")))
    merged = grouped.groupBy("media_id", "group_start").agg(
        F.min_by("ord", "position").alias("ord"), F.min("start").alias("start"), F.max("end").alias("end"),
        pieces.alias("_p"))
    joined = F.aggregate(
        F.slice("_p", F.lit(2), F.size("_p")), F.element_at("_p", 1)["text"],
        lambda acc, x: strip(F.concat(rstrip(acc), F.lit(" "), lstrip(x["text"]))))
    return merged.select("media_id", "ord", "start", "end", joined.alias("text"),
                         F.size("_p").cast("bigint").alias("merged_from"))


def quality_slots(segments: DataFrame, media: DataFrame, min_gap: float = 0.045,
                  headroom: float = 0.99) -> DataFrame:
    """Room for each phrase: spoken, target and hard slot.  ``media`` has media_id, video_dur."""
    ahead = o.ordered_scan(segments, KEY, ORDER, o.every("start", HOUR),
                           _next=o.following(F.struct(F.col("start").alias("s"))))
    video = F.coalesce(F.when(F.col("video_dur") != 0, F.col("video_dur")), F.col("end"))
    until = F.when(F.col("_next").isNotNull(), F.greatest("start", F.col("_next.s") - min_gap)).otherwise(
        F.greatest(F.col("end"), video))
    hard = F.greatest(F.lit(0.0), F.least(video, until) - F.col("start"))
    return (ahead.join(media.select("media_id", "video_dur"), "media_id", "left")
            .withColumn("spoken_slot", F.greatest(F.lit(0.05), F.col("end") - F.col("start")))
            .withColumn("hard_slot", hard)
            .withColumn("target_slot", F.greatest(F.lit(0.08), F.col("hard_slot") * headroom))
            .drop("_next", "video_dur"))


def speech_boundaries(segments: DataFrame) -> DataFrame:
    """Distinct starts and ends per media, rounded to six digits."""
    return segments.select(
        "media_id", F.explode(F.array(F.bround("start", 6), F.bround("end", 6))).alias("boundary")).distinct()


def assemble_text(segments: DataFrame, col: str = "text", sep: str = " ", part_rows: int = 10000) -> DataFrame:
    """Text of a media in order, in parts of at most ``part_rows`` segments.

    Part texts joined with ``sep`` in part order are the whole text; a part
    bounds what one task holds.
    """
    kept = segments.withColumn("_t", strip(col)).filter(F.col("_t") != "")
    placed = o.ordered_scan(kept, KEY, ORDER, o.every("start", HOUR), _n=o.row_number())
    pieces = F.array_sort(F.collect_list(F.struct("_n", "_t")))
    return (placed.groupBy("media_id", F.floor((F.col("_n") - 1) / part_rows).cast("bigint").alias("part"))
            .agg(pieces.alias("_p"))
            .select("media_id", "part", F.size("_p").cast("bigint").alias("segments"),
                    F.array_join(F.transform("_p", lambda p: p["_t"]), sep).alias("text")))


def progress_eta(batches: DataFrame) -> DataFrame:
    """Progress after each batch.  Input: media_id, batch_no, size, elapsed_sec, total, cache_hits."""
    done = o.ordered_scan(batches, KEY, ["batch_no"], o.every("batch_no", 10000), _sum=o.running_sum(F.col("size")))
    processed = F.col("cache_hits") + F.col("_sum")
    eta = (F.greatest(F.lit(0.001), F.col("elapsed_sec")) / F.greatest(F.lit(1), processed)
           * F.greatest(F.lit(0), F.col("total") - processed))
    return done.withColumn("processed", processed.cast("bigint")).withColumn(
        "eta_sec", F.floor(eta).cast("bigint")).drop("_sum")


def pace_requests(requests: DataFrame, interval: float = 0.35) -> DataFrame:
    """Earliest start of each request at ``interval`` spacing.  Input: service, ord, arrival (s).

    grant(i) = max over j <= i of arrival(j) + interval * (i - j).
    """
    order = ["arrival", "ord"]
    calls = requests.withColumn("_block", o.every("arrival", 600))
    numbered = o.ordered_scan(calls, ["service"], order, "_block", _i=o.row_number())
    lead = o.ordered_scan(numbered, ["service"], order, "_block",
                          _m=o.running_max(F.col("arrival") - interval * F.col("_i")))
    return (lead.withColumn("granted_at", F.col("_m") + interval * F.col("_i"))
            .withColumn("wait", F.col("granted_at") - F.col("arrival")).drop("_i", "_m", "_block"))
