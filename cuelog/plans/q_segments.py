"""Queries over segments and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators import media as md
from ..operators import segments as sg
from ..operators import timeline as tl
from ..sources import writers as wr
from . import views as v
from .registry import register
from .views import with_views

MERGE_STEP = """
    numbered AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ord) AS rn FROM v_seg),
    walk AS (
        SELECT media_id, rn, 1::BIGINT AS grp, "start" AS s, "end" AS e FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.media_id, n.rn, CASE WHEN ok THEN grp ELSE grp + 1 END, CASE WHEN ok THEN s ELSE n."start" END,
               CASE WHEN ok THEN greatest(e, n."end") ELSE n."end" END
        FROM (SELECT w.*, n.rn AS nrn, greatest(0e0, w.e - w.s) < 1.5e0 AND greatest(0e0, n."start" - w.e) <= 0.38e0
                     AND greatest(w.e, n."end") - w.s <= 5.8e0 AS ok
              FROM walk w JOIN numbered n ON n.media_id = w.media_id AND n.rn = w.rn + 1) x
        JOIN numbered n ON n.media_id = x.media_id AND n.rn = x.nrn)
"""


@register("nonempty_segments", with_views(r"""
    SELECT media_id, ord, seg_index FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ord) AS seg_index
    FROM v_seg) WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""", "v_seg"))
def _(spark, sf):
    return sg.nonempty_segments(v.v_seg(spark, sf)).select("media_id", "ord", "seg_index")


@register("merge_short_segments", with_views("""
    SELECT w.media_id, grp AS group_no, round(min(n."start"), 3) AS start_sec, round(max(n."end"), 3) AS end_sec,
           count(*) AS merged_from, sum(length(text)) + count(*) - 1 AS text_length
    FROM walk w JOIN numbered n USING (media_id, rn) GROUP BY w.media_id, grp""",
    "v_seg").replace("\n\n    SELECT w.media_id", "," + MERGE_STEP + "SELECT w.media_id"))
def _(spark, sf):
    from ..functions import ordered as o
    merged = sg.merge_short_segments(v.v_seg(spark, sf), min_dur=1.5)
    numbered = o.ordered_scan(merged, ["media_id"], ["start", "ord"], o.every("start", 3600), group_no=o.row_number())
    return numbered.select("media_id", "group_no", F.round("start", 3).alias("start_sec"),
                           F.round("end", 3).alias("end_sec"), "merged_from",
                           F.length("text").cast("bigint").alias("text_length"))


@register("quality_slots", with_views("""
    SELECT media_id, ord, round(spoken_slot, 3) AS spoken_slot, round(target_slot, 3) AS target_slot,
           round(hard_slot, 3) AS hard_slot FROM v_slots""", "v_slots"))
def _(spark, sf):
    slots = sg.quality_slots(v.v_seg(spark, sf), v.v_media(spark, sf))
    return slots.select("media_id", "ord", *[F.round(c, 3).alias(c) for c in ("spoken_slot", "target_slot", "hard_slot")])


NORM = r"array_to_string(regexp_extract_all(lower(text), '[\pL\pN_]+'), ' ')"
RUNS = f"""SELECT *, sum(CASE WHEN is_repeat THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY "start", ord) AS run_id
    FROM (SELECT *, norm <> '' AND coalesce(norm = lag(norm) OVER (PARTITION BY media_id ORDER BY "start", ord), false)
          AS is_repeat FROM (SELECT *, {NORM} AS norm FROM v_asr))"""


@register("repeat_runs", with_views("""
    SELECT media_id, ord, CAST(run_id AS BIGINT) AS run_id, is_repeat,
           count(CASE WHEN norm <> '' THEN 1 END) OVER (PARTITION BY media_id, run_id) AS run_len FROM runs""",
    "v_asr", runs=RUNS))
def _(spark, sf):
    return sg.repeat_runs(v.v_asr(spark, sf)).select("media_id", "ord", "run_id", "is_repeat", "run_len")


@register("asr_quality", with_views("""
    SELECT a.*, longest_repeat_run, longest_repeat_run >= 3 OR suspicious_ratio >= 0.25 AS warn FROM (
        SELECT media_id, count(*) AS segments, count(*) FILTER (has_words) AS word_timed_segments,
            count(*) FILTER (avg_logprob < -0.9) AS low_logprob_segments,
            count(*) FILTER (compression_ratio > 2.4) AS high_compression_segments,
            count(*) FILTER (no_speech_prob > 0.6) AS high_no_speech_segments,
            count(*) FILTER (temperature > 0.5) AS temperature_fallback_segments,
            count(*) FILTER (is_repeat) AS repeated_adjacent_segments,
            round(count(*) FILTER (avg_logprob < -0.9 OR compression_ratio > 2.4) / count(*), 4) AS suspicious_ratio
        FROM runs GROUP BY media_id) a
    JOIN (SELECT media_id, max(n) AS longest_repeat_run FROM (SELECT media_id, run_id,
          count(CASE WHEN norm <> '' THEN 1 END) AS n FROM runs GROUP BY ALL) GROUP BY media_id) USING (media_id)""",
    "v_asr", runs=RUNS))
def _(spark, sf):
    return sg.asr_quality(v.v_asr(spark, sf))


@register("passthrough", """
    SELECT media_id, language, letters, script_letters,
           language = 'en' AND script_letters >= 6 AND script_letters >= letters * 0.45e0 AS passthrough FROM (
        SELECT source AS media_id, max(lang) AS language,
            CAST(sum(length(regexp_replace(text, '[^\\pL]', '', 'g'))) AS BIGINT) AS letters,
            CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS script_letters
        FROM documents GROUP BY source)""".replace("\\\\", "\\"))
def _(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("source").alias("media_id"), F.col("lang").alias("language"), "text")
    return sg.passthrough(docs, "en", "[A-Za-z]")


@register("stitch_chunks", with_views("""
    SELECT media_id, chunk, id0, row_number() OVER (PARTITION BY media_id ORDER BY chunk, id0) - 1 AS id,
           round("start", 3) AS start_sec, round("end", 3) AS end_sec, round("start", 3) AS word_start
    FROM (SELECT media_id, ord // 3 AS chunk, ord % 3 AS id0, ord // 3 * 30e0 + "start" AS "start",
                 ord // 3 * 30e0 + "end" AS "end" FROM v_seg)""", "v_seg"))
def _(spark, sf):
    chunked = v.v_seg(spark, sf).select(
        "media_id", F.floor(F.col("ord") / 3).alias("chunk"), (F.col("ord") % 3).alias("id"), (F.col("ord") % 3).alias("id0"),
        "start", "end", F.array(F.struct("start", "end", F.col("text").alias("word"))).alias("words"))
    return sg.stitch_chunks(chunked).select(
        "media_id", "chunk", "id0", "id", F.round("start", 3).alias("start_sec"), F.round("end", 3).alias("end_sec"),
        F.round(F.col("words")[0]["start"], 3).alias("word_start"))


@register("detect_language", """
    WITH chunks AS (SELECT source AS media_id, doc_id AS chunk, text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS language,
            doc_id % 3 AS n_segments FROM documents),
    first AS (SELECT media_id, count(*) AS chunks, min(CASE WHEN language <> '' THEN chunk END) AS from_chunk,
            min_by(language, chunk) FILTER (language <> '') AS language FROM chunks GROUP BY media_id),
    stop AS (SELECT c.media_id, min(chunk) AS stop_chunk FROM chunks c JOIN first f USING (media_id)
            WHERE chunk >= from_chunk AND n_segments > 0 AND f.language IN ('en', 'de')
              AND regexp_matches(text, '\\S') GROUP BY c.media_id)
    SELECT media_id, coalesce(language, '') AS language, coalesce(stop_chunk + 1, chunks) AS chunks_used,
           stop_chunk IS NOT NULL AS early_stop FROM first LEFT JOIN stop USING (media_id)""".replace("\\\\", "\\"))
def _(spark, sf):
    chunks = v.table(spark, sf, "documents").select(
        F.col("source").alias("media_id"), F.col("doc_id").alias("chunk"), "text",
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("language"),
        (F.col("doc_id") % 3).alias("n_segments"))
    return sg.detect_language(chunks, ["en", "de"])


@register("speech_boundaries", with_views("""
    SELECT DISTINCT media_id, round(b, 6) AS boundary FROM (
        SELECT media_id, "start" AS b FROM v_seg UNION ALL SELECT media_id, "end" FROM v_seg)""", "v_seg"))
def _(spark, sf):
    return sg.speech_boundaries(v.v_seg(spark, sf))


@register("assemble_text", with_views(r"""
    SELECT media_id, CAST((rn - 1) // 4 AS BIGINT) AS part, count(*) AS segments, string_agg(t, ' ' ORDER BY rn) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ord) AS rn FROM (
        SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM v_seg) WHERE t <> '')
    GROUP BY media_id, (rn - 1) // 4""", "v_seg"))
def _(spark, sf):
    return sg.assemble_text(v.v_seg(spark, sf), part_rows=4)


@register("progress_eta", with_views("""
    SELECT media_id, ord AS batch_no, CAST(ord + done AS BIGINT) AS processed,
        CAST(floor(greatest(0.001e0, elapsed) / greatest(1, ord + done) * greatest(0, 64 - (ord + done))) AS BIGINT) AS eta_sec
    FROM (SELECT media_id, ord, "end" AS elapsed, sum(length(text) % 8 + 1) OVER (PARTITION BY media_id ORDER BY ord) AS done
          FROM v_seg)""", "v_seg"))
def _(spark, sf):
    batches = v.v_seg(spark, sf).select(
        "media_id", F.col("ord").alias("batch_no"), (F.length("text") % 8 + 1).alias("size"),
        F.col("end").alias("elapsed_sec"), F.lit(64).alias("total"), F.col("ord").alias("cache_hits"))
    return sg.progress_eta(batches).select("media_id", "batch_no", "processed", "eta_sec")


@register("pace_requests", with_views("""
    SELECT service, seq AS ord, round(m + 0.5e0 * i, 3) AS granted_at, round(m + 0.5e0 * i - arrival, 3) AS wait FROM (
        SELECT *, max(arrival - 0.5e0 * i) OVER (PARTITION BY service ORDER BY arrival, seq) AS m FROM (
            SELECT *, row_number() OVER (PARTITION BY service ORDER BY arrival, seq) AS i FROM (
                SELECT service, seq, CAST(epoch_ms(date_trunc('hour', ts)) // 1000 AS DOUBLE) AS arrival FROM v_req)))""",
    "v_req"))
def _(spark, sf):
    calls = v.v_req(spark, sf).select("service", F.col("seq").alias("ord"),
                                      F.expr("cast(timestampdiff(SECOND, timestamp'1970-01-01 00:00:00', date_trunc('hour', ts)) AS double)").alias("arrival"))
    paced = sg.pace_requests(calls, interval=0.5)
    return paced.select("service", "ord", F.round("granted_at", 3).alias("granted_at"), F.round("wait", 3).alias("wait"))


# ---------------------------------------------------------------- timeline
def _slots(spark, sf):
    return sg.quality_slots(v.v_tts(spark, sf), v.v_media(spark, sf))


def _placed(spark, sf):
    tts = v.v_tts(spark, sf)
    return tl.place_timeline(_slots(spark, sf).drop("tts_dur"), tts.select("media_id", "ord", "tts_dur"),
                             v.v_media(spark, sf))


def _raw_pauses(spark, sf):
    return tl.pauses_of(_placed(spark, sf))


@register("tempo_plan", with_views("""
    SELECT media_id, ord, native_rate, round(tempo, 3) AS tempo, round(cur / tempo, 3) AS final_dur,
           round(greatest(1e0, tts_dur / (cur / tempo)), 3) AS total_speed, cur / tempo > hard_slot + 0.035e0 AS video_pause_needed
    FROM (SELECT *, CASE WHEN cur / target_slot > 1.025e0 AND cap > 1.025e0
                         THEN least(cur / target_slot, cap, 1.25e0) ELSE 1e0 END AS tempo
          FROM (SELECT *, greatest(1e0, 1.15e0 / greatest(1e0, tts_dur / cur)) AS cap
                FROM (SELECT *, CASE WHEN rate > 0 AND native < tts_dur * 0.995e0 THEN native ELSE tts_dur END AS cur,
                             CASE WHEN rate > 0 AND native < tts_dur * 0.995e0 THEN rate ELSE 0 END AS native_rate
                      FROM (SELECT *, tts_dur * 0.875e0 + 0.125e0 AS native, CASE WHEN needed <= 1.04e0 THEN 0 ELSE
                            CAST(floor(greatest(0e0, least((1.15e0 - 1e0) * 100, round_even((needed - 1e0) * 100, 0)))) AS INT) END AS rate
                            FROM (SELECT *, least(tts_dur / target_slot, 1.15e0) AS needed FROM v_slots
                                  WHERE tts_dur IS NOT NULL)))))""", "v_slots"))
def _(spark, sf):
    durations = v.v_tts(spark, sf).select("media_id", "ord", F.col("tts_dur").alias("base_dur"),
                                          (F.col("tts_dur") * 0.875 + 0.125).alias("native_dur"))
    plan = tl.tempo_plan(_slots(spark, sf), durations)
    return plan.select("media_id", "ord", "native_rate", *[F.round(c, 3).alias(c) for c in
                                                           ("tempo", "final_dur", "total_speed")], "video_pause_needed")


@register("place_timeline", with_views("""
    SELECT media_id, ord, delay_ms, round(pause_extra, 3) AS pause_extra, round(freeze_at, 3) AS freeze_at,
           round(shifted_start, 3) AS shifted_start FROM v_placed""", "v_placed"))
def _(spark, sf):
    return _placed(spark, sf).select("media_id", "ord", "delay_ms", *[F.round(c, 3).alias(c) for c in (
        "pause_extra", "freeze_at", "shifted_start")])


PAUSES = 'SELECT media_id, ord, freeze_at AS "at", pause_extra AS duration FROM v_placed WHERE pause_extra > 0'
SANITIZED = """
    pnum AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "at", ord) AS rn FROM pauses),
    pwalk AS (SELECT media_id, rn, 1::BIGINT AS grp, "at" AS anchor FROM pnum WHERE rn = 1
        UNION ALL
        SELECT n.media_id, n.rn, CASE WHEN abs(w.anchor - n."at") < {within} THEN grp ELSE grp + 1 END,
               CASE WHEN abs(w.anchor - n."at") < {within} THEN anchor ELSE n."at" END
        FROM pwalk w JOIN pnum n ON n.media_id = w.media_id AND n.rn = w.rn + 1),
    clean AS (SELECT w.media_id, min("at") AS "at", sum(duration) AS duration, string_agg(ord, ',' ORDER BY n.rn) AS segments
              FROM pwalk w JOIN pnum n USING (media_id, rn) GROUP BY w.media_id, grp)
"""


def _after_views(body: str, steps: str, *views: str, **more: str) -> str:
    """Insert recursive steps between the views and the final select."""
    return with_views("@@" + body, *views, **more).replace("\n@@", "," + steps)


@register("sanitize_pauses", _after_views("""
    SELECT media_id, round("at", 3) AS "at", round(duration, 3) AS duration, segments FROM clean""",
    SANITIZED.format(within="1.5e0"), "v_placed", pauses=PAUSES))
def _(spark, sf):
    clean = tl.sanitize_pauses(_raw_pauses(spark, sf), v.v_media(spark, sf), within=1.5)
    return clean.select("media_id", F.round("at", 3).alias("at"), F.round("duration", 3).alias("duration"),
                        F.array_join(F.transform("segments", lambda s: s.cast("string")), ",").alias("segments"))


MERGED = SANITIZED.format(within="0.02e0") + """,
    bounds AS (SELECT media_id, "start" AS b FROM v_seg UNION SELECT media_id, "end" FROM v_seg),
    pairs AS (SELECT *, lag("at") OVER (PARTITION BY media_id ORDER BY "at") AS prev FROM clean),
    cut AS (SELECT *, prev IS NULL OR "at" - prev > 2.5e0 OR EXISTS (SELECT 1 FROM bounds WHERE bounds.media_id = pairs.media_id
            AND b > prev + 0.001e0 AND b < "at" - 0.001e0) AS fresh FROM pairs),
    grouped AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY "at") AS g FROM cut),
    final AS (SELECT media_id, max("at") AS "at", sum(duration) AS duration, string_agg(segments, ',' ORDER BY grouped."at") AS segments
              FROM grouped GROUP BY media_id, g)
"""


@register("merge_nearby_pauses", _after_views("""
    SELECT media_id, round("at", 3) AS "at", round(duration, 3) AS duration, segments FROM final""",
    MERGED, "v_placed", pauses=PAUSES))
def _(spark, sf):
    merged = tl.merge_nearby_pauses(_raw_pauses(spark, sf), v.v_seg(spark, sf), v.v_media(spark, sf), max_distance=2.5)
    return merged.select("media_id", F.round("at", 3).alias("at"), F.round("duration", 3).alias("duration"),
                         F.array_join(F.transform("segments", lambda s: s.cast("string")), ",").alias("segments"))


def _round_exact(x: str, digits: int) -> str:
    """``round_exact`` in SQL: DuckDB's own rounding takes the rounded product for the value."""
    scale, split = 10.0 ** (digits + 1), 134217729.0
    high = scale * split - (scale * split - scale)
    low, top = scale - high, f"(x * {split!r}::DOUBLE - (x * {split!r}::DOUBLE - x))"
    bottom, product = f"(x - {top})", f"(x * {scale!r}::DOUBLE)"
    error = f"((({top} * {high!r}::DOUBLE - {product}) + {top} * {low!r}::DOUBLE + {bottom} * {high!r}::DOUBLE) + {bottom} * {low!r}::DOUBLE)"
    side = f"sign(({product} - round_even({product}, 0)) + {error})"
    tie = f"(abs(round_even({product}, 0)::HUGEINT % 10) = 5 AND abs({product} - round_even({product}, 0)) < 0.25)"
    made = f"CASE WHEN {tie} THEN round_even((round_even({product}, 0) + {side}) / 10, 0) / {10.0 ** digits!r}::DOUBLE ELSE round(x, {digits}) END"
    return f"list_transform([{x}], lambda x: {made})[1]"


@register("pause_summary", _after_views(f"""
    SELECT m.media_id, coalesce(b, 0) AS before, coalesce(n, 0) AS pause_count,
        greatest(0, coalesce(b, 0) - coalesce(n, 0)) AS merged, {_round_exact("coalesce(total, 0e0)", 3)} AS total_pause_sec,
        {_round_exact("coalesce(total, 0e0) / video_dur", 5)} AS pause_ratio, coalesce(sev, 0) AS severe_pause_count,
        {_round_exact("coalesce(mx, 0e0)", 3)} AS max_pause_sec
    FROM v_media m LEFT JOIN (SELECT media_id, count(*) AS b FROM clean GROUP BY 1) USING (media_id)
    LEFT JOIN (SELECT media_id, count(*) AS n, sum(CAST(duration AS DECIMAL(28,12)))::DOUBLE AS total, max(duration) AS mx,
               count(*) FILTER (duration >= 2) AS sev FROM final GROUP BY 1) USING (media_id)""",
    MERGED, "v_placed", pauses=PAUSES))
def _(spark, sf):
    media = v.v_media(spark, sf)
    raw = _raw_pauses(spark, sf)
    merged = tl.merge_nearby_pauses(raw, v.v_seg(spark, sf), media, max_distance=2.5)
    out = tl.pause_summary(tl.sanitize_pauses(raw, media), merged, media)
    return out


@register("has_boundary_between", with_views("""
    SELECT media_id, ord, EXISTS (SELECT 1 FROM v_seg b WHERE b.media_id = p.media_id AND (
        (b."start" > p.lo + 0.001e0 AND b."start" < p.hi - 0.001e0) OR (b."end" > p.lo + 0.001e0 AND b."end" < p.hi - 0.001e0)))
        AS boundary_between FROM (SELECT media_id, ord, "end" AS lo, "end" + 0.5e0 AS hi FROM v_seg) p""", "v_seg"))
def _(spark, sf):
    seg = v.v_seg(spark, sf)
    spans = seg.select("media_id", "ord", F.col("end").alias("left"), (F.col("end") + 0.5).alias("right"))
    return tl.has_boundary_between(spans, sg.speech_boundaries(seg)).select("media_id", "ord", "boundary_between")


@register("shift_by_pauses", with_views("""
    SELECT media_id, ord, round("end" + coalesce((SELECT sum(duration) FROM pauses p WHERE p.media_id = s.media_id
        AND p."at" <= s."end" + 1e-6), 0e0), 3) AS shifted FROM v_seg s""", "v_placed", pauses=PAUSES))
def _(spark, sf):
    points = v.v_seg(spark, sf).select("media_id", "ord", "end")
    moved = tl.shift_by_pauses(points, _raw_pauses(spark, sf), "end")
    return moved.select("media_id", "ord", F.round("shifted", 3).alias("shifted"))


@register("top_pauses", with_views("""
    SELECT media_id, round("at", 3) AS "at", round(duration, 3) AS duration, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY duration DESC, "at") AS rank FROM pauses
        WHERE duration >= 1) WHERE rank <= 3""", "v_placed", pauses=PAUSES))
def _(spark, sf):
    best = tl.top_pauses(_raw_pauses(spark, sf), min_sec=1.0, k=3)
    return best.select("media_id", F.round("at", 3).alias("at"), F.round("duration", 3).alias("duration"), "rank")


@register("quantize_pauses", with_views("""
    SELECT media_id, round(coalesce(frames / fps, raw), 3) AS effective_sec, frames FROM (
        SELECT media_id, max(f) AS fps, sum(duration) AS raw, CAST(sum(floor(duration * f + 0.5e0)) AS BIGINT) AS frames
        FROM (SELECT p.*, CASE WHEN media_id % 3 = 0 THEN NULL ELSE fps END AS f FROM pauses p JOIN v_media USING (media_id))
        GROUP BY media_id)""", "v_placed", pauses=PAUSES))
def _(spark, sf):
    rates = v.v_media(spark, sf).withColumn("fps", F.expr("CASE WHEN media_id % 3 <> 0 THEN fps END"))
    out = tl.quantize_pauses(_raw_pauses(spark, sf), rates)
    return out.select("media_id", F.round("effective_sec", 3).alias("effective_sec"), "frames")


@register("mix_plan", with_views("""
    SELECT media_id, group_no, count(*) AS phrases, round(CASE WHEN group_no < max(last) THEN least(max(video_dur),
        ceil((max(delay_ms / 1000e0 + tts_dur) + 0.1e0) * 1000) / 1000) ELSE max(video_dur) END, 3) AS group_duration
    FROM (SELECT *, CAST((rn - 1) // 3 AS BIGINT) AS group_no, CAST((n - 1) // 3 AS BIGINT) AS last FROM (
        SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ord) AS rn,
               count(*) OVER (PARTITION BY media_id) AS n FROM v_placed)) GROUP BY media_id, group_no""", "v_placed"))
def _(spark, sf):
    media = v.v_media(spark, sf).withColumnRenamed("video_dur", "final_dur")
    plan = tl.mix_plan(_placed(spark, sf), media, size=3)
    return plan.withColumn("group_duration", F.round("group_duration", 3))


STAMP = ("lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
         "lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')")


@register("to_srt", with_views(rf"""
    SELECT media_id, CAST((seq - 1) // 3 AS BIGINT) AS part, count(*) AS cues,
           string_agg(seq || chr(10) || {STAMP.replace('ms', 's_ms')} || ' --> ' || {STAMP.replace('ms', 'e_ms')} || chr(10) || t,
                      chr(10) || chr(10) ORDER BY seq) || chr(10) AS document
    FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ord) AS seq,
            CAST(round_even(s * 1000, 0) AS BIGINT) AS s_ms,
            CAST(round_even(CASE WHEN e <= s THEN s + 0.08e0 ELSE e END * 1000, 0) AS BIGINT) AS e_ms FROM (
        SELECT *, "start" + coalesce((SELECT sum(duration) FROM pauses p WHERE p.media_id = g.media_id AND p."at" <= g."start" + 1e-6), 0e0) AS s,
               "end" + coalesce((SELECT sum(duration) FROM pauses p WHERE p.media_id = g.media_id AND p."at" <= g."end" + 1e-6), 0e0) AS e,
               regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM v_seg g) WHERE t <> '')
    GROUP BY media_id, (seq - 1) // 3""", "v_seg",
    pauses="""SELECT media_id, "end" AS "at", 0.125e0 * (1 + length(text) % 7) AS duration FROM v_seg WHERE length(text) > 300"""))
def _(spark, sf):
    seg = v.v_seg(spark, sf)
    pauses = seg.filter("length(text) > 300").select(
        "media_id", F.col("end").alias("at"), F.expr("0.125D * (1 + length(text) % 7)").alias("duration"))
    return wr.to_srt(seg, pauses, "text", part_cues=3)


# ---------------------------------------------------------------- media files
STREAMS = """SELECT l_orderkey AS media_id, CASE WHEN l_returnflag = 'R' THEN 'audio' ELSE 'video' END AS kind,
        l_linenumber AS "index", l_partkey AS partkey, l_linestatus = 'F' AS is_default,
        l_returnflag = 'N' AND l_linestatus = 'O' AS attached_pic,
        CASE WHEN l_partkey % 17 = 0 THEN 0.5e0 ELSE 0.0625e0 END AS start_time, l_quantity AS duration,
        CASE WHEN l_suppkey % 2 = 0 THEN 25e0 ELSE 5e0 END AS fps FROM lineitem"""


def _streams(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.expr("CASE WHEN l_returnflag = 'R' THEN 'audio' ELSE 'video' END").alias("kind"),
        # files repeat a line number, so the part and the amount complete the stream's place
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("index"),
        F.expr("l_linestatus = 'F'").alias("is_default"),
        F.expr("l_returnflag = 'N' AND l_linestatus = 'O'").alias("attached_pic"),
        F.expr("CASE WHEN l_partkey % 17 = 0 THEN 0.5D ELSE 0.0625D END").alias("start_time"),
        F.col("l_quantity").alias("duration"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 25D ELSE 5D END").alias("fps"))


def _expected(spark, sf):
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice / 10000) END").cast("double").alias("video_expected"),
        F.lit(None).cast("double").alias("audio_expected"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN 25D END").alias("shared_expected"))


CHOSEN = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, kind ORDER BY is_default DESC, "index", partkey,
        suppkey, duration, price) AS pick FROM streams WHERE NOT (kind = 'video' AND attached_pic)) WHERE pick = 1"""
STREAMS_FULL = STREAMS.replace("l_partkey AS partkey,", "l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS price,")
EXPECTED = """SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 10000) END AS video_expected,
        CASE WHEN o_orderstatus <> 'P' THEN 25e0 END AS shared_expected,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 500 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders"""


@register("default_stream", with_views("""SELECT media_id, kind, CAST("index" AS BIGINT) AS stream_index, is_default, duration FROM chosen""",
                                       streams=STREAMS_FULL, chosen=CHOSEN))
def _(spark, sf):
    return md.default_stream(_streams(spark, sf)).select(
        "media_id", "kind", F.col("index.l_linenumber").cast("bigint").alias("stream_index"), "is_default", "duration")


@register("attach_expected", with_views("""SELECT media_id, kind, duration,
        coalesce(CASE WHEN kind = 'video' THEN video_expected END, shared_expected) AS expected_duration
        FROM chosen LEFT JOIN expected USING (media_id)""", streams=STREAMS_FULL, chosen=CHOSEN, expected=EXPECTED))
def _(spark, sf):
    return md.attach_expected(md.default_stream(_streams(spark, sf)), _expected(spark, sf)).select(
        "media_id", "kind", "duration", "expected_duration")


@register("validate_media", with_views("""
    SELECT media_id, size, reason = 'ok' AS valid, reason FROM (
        SELECT e.media_id, e.size, CASE WHEN e.size < 1000 THEN 'output_missing_or_too_small'
            WHEN v.media_id IS NULL OR a.media_id IS NULL THEN 'missing_video_or_audio_stream'
            WHEN v.fail IS NOT NULL THEN 'video_' || v.fail WHEN a.fail IS NOT NULL THEN 'audio_' || a.fail ELSE 'ok' END AS reason
        FROM expected e LEFT JOIN (SELECT * FROM checked WHERE kind = 'video') v USING (media_id)
        LEFT JOIN (SELECT * FROM checked WHERE kind = 'audio') a USING (media_id))""",
    streams=STREAMS_FULL, chosen=CHOSEN, expected=EXPECTED,
    checked="""SELECT *, CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 'invalid_expected_duration'
        WHEN duration <= 0 THEN 'invalid_stream_timing' WHEN abs(start_time) > tol THEN 'unexpected_start_time'
        WHEN abs(start_time + duration - x) > tol THEN 'duration_mismatch' END AS fail FROM (
            SELECT *, coalesce(CASE WHEN kind = 'video' THEN video_expected END, shared_expected) AS x,
                   CASE WHEN kind = 'video' THEN greatest(0.12e0, 1 / fps) ELSE 0.12e0 END AS tol
            FROM chosen LEFT JOIN expected USING (media_id))"""))
def _(spark, sf):
    files = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN 500 ELSE cast(floor(o_totalprice) AS bigint) END").alias("size"))
    return md.validate_media(files, _streams(spark, sf), _expected(spark, sf))
