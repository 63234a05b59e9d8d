"""Queries over translation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.batching import build_marker_batch, parse_marker_batch
from ..functions.text import (CYRILLIC, LATIN, NUMERIC_TOKEN, PROTECTED_TOKEN, numeric_tokens, protected_tokens, shared_words, tokens_preserved)
from ..operators import pairs as pr
from ..sources import review as rv
from . import views as v
from .registry import register
from .views import with_views


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _verdict(text: str, source: str, rows: str) -> str:
    """SQL for the response verdict, written as one pass over flags."""
    return rf"""SELECT *, CASE WHEN v = '' THEN 'empty_response'
            WHEN html AND (srv OR sen OR blk OR st <> '') THEN 'provider_html_error_page'
            WHEN NOT ment AND sen AND (srv OR st <> '') THEN CASE WHEN st = '500' THEN 'provider_error_page_500' ELSE 'provider_error_text' END
            WHEN NOT ment AND blk THEN 'provider_block_or_captcha_page'
            WHEN NOT ment AND length(v) <= 5000 AND st <> '' AND srv THEN 'provider_http_' || st ELSE 'ok' END AS reason
        FROM (SELECT *, regexp_matches(v, '(?i)<(?:!doctype\s+html|html|head|body|title|script|style)\b') AS html,
            regexp_matches(v, '(?i)\b(?:server\s+error|service\s+unavailable|bad\s+gateway|gateway\s+time-?out|too\s+many\s+requests)\b') AS srv,
            regexp_matches(v, '(?i)there\s+was\s+an\s+error\.?\s*please\s+try\s+again\s+later\.?') AS sen,
            regexp_matches(v, '(?i)\b(?:our\s+systems\s+have\s+detected\s+unusual\s+traffic|automated\s+queries|captcha|access\s+denied|temporarily\s+blocked)\b') AS blk,
            regexp_extract(v, '(?i)^\s*(?:error\s*)?(?:http(?:/\d(?:\.\d)?)?\s*)?(?:code\s*)?(429|5\d\d)\b', 1) AS st,
            regexp_matches(lower(coalesce({source}, '')), 'error 500|server error|there was an error|service unavailable|bad gateway|too many requests') AS ment
            FROM (SELECT *, {_strip(f"coalesce({text}, '')")} AS v FROM {rows}))"""


@register("validate_response", with_views(r"""
    SELECT doc_id, reason = 'ok' AS valid, reason, length(v) AS response_length, sha256(v) AS response_sha256,
        CASE WHEN v = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN html THEN 'html_markup' END, CASE WHEN srv THEN 'server_error_phrase' END,
            CASE WHEN sen THEN 'google_error_sentence' END, CASE WHEN blk THEN 'provider_block_page' END,
            CASE WHEN st <> '' THEN 'http_status_' || st END) END AS signals,
        CASE WHEN length(p) > 320 THEN regexp_replace(substr(p, 1, 317), '\s+$', '') || '...' ELSE p END AS preview
    FROM (SELECT *, regexp_replace(v, '\s+', ' ', 'g') AS p FROM verdict)""", "v_resp",
    verdict=_verdict("text", "source", "v_resp")))
def _(spark, sf):
    out = pr.validate_response(v.v_resp(spark, sf), "text", "source")
    return out.select("doc_id", "valid", "reason", "response_length", "response_sha256",
                      F.array_join("signals", ",").alias("signals"), "preview")


@register("quality_gate")
def _(spark, sf):
    out = pr.quality_gate(v.v_pair(spark, sf))
    return out.select("pair_id", "ok", F.array_join("reasons", ",").alias("reasons"))


TECH = "[" + ", ".join(f"'{w}'" for w in pr.TECH_WORDS) + "]"


def _lost(a: str, b: str) -> str:
    """Some token is more often in ``a`` than in ``b``."""
    return f"len(list_filter(list_distinct({a}), lambda x: len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x)))) > 0"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{NUMERIC_TOKEN}'), lambda t: regexp_replace(t, '[^0-9]', '', 'g'))"


def _guarded(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '(?i){PROTECTED_TOKEN}'), lambda t: lower(rtrim(t, '.,;:!?)]}}'))), lambda t: t <> '')"


@register("quality_gate_rules", with_views(rf"""
    SELECT pair_id, CASE WHEN e THEN 'empty' ELSE concat_ws(',', CASE WHEN short THEN 'too_short' END, CASE WHEN num THEN 'numeric_token_changed' END, CASE WHEN prot THEN 'protected_token_changed' END,
        CASE WHEN l THEN 'source_language_left' WHEN ru AND cyr >= 8 AND shared >= 2 THEN 'source_words_left' WHEN ru AND cyr >= 8 AND long > 0 THEN 'source_word_left' END) END AS reasons
    FROM (SELECT *, ru AND ordinary >= 3 AND lat / greatest(1, lat + cyr) >= 0.28 AS l FROM (
        SELECT pair_id, {_strip('d')} = '' AS e, length({_strip('d')}) < greatest(3, floor(length({_strip('s')}) * 0.16)) AS short, {_lost(_numbers('s'), _numbers('d'))} AS num, {_lost(_guarded('s'), _guarded('d'))} AS prot,
            target_lang = 'ru' AND source_lang IN ({', '.join(f"'{c}'" for c in pr.LATIN_LANGUAGES)}) AS ru,
            length(regexp_replace(d, '[^{LATIN}]', '', 'g')) AS lat, length(regexp_replace(d, '[^{CYRILLIC}]', '', 'g')) AS cyr,
            len(list_filter(dw, lambda w: regexp_matches(w, '[{LATIN}]') AND NOT list_contains({TECH}, trim(lower(w), '._-/')) AND NOT regexp_matches(w, '\d') AND length(w) > 2 AND NOT regexp_matches(w, '^\p{{Lu}}.*\p{{Lu}}'))) AS ordinary,
            len(list_filter(dl, lambda w: length(w) > 3 AND list_contains(sl, lower(w)) AND NOT list_contains({TECH}, lower(w)))) AS shared,
            len(list_filter(dl, lambda w: length(w) >= 9 AND w = lower(w) AND list_contains(sl, w) AND NOT list_contains({TECH}, w))) AS long
        FROM (SELECT *, regexp_extract_all(bd, '[{LATIN}{CYRILLIC}0-9][{LATIN}{CYRILLIC}0-9_+.#/-]*') AS dw, regexp_extract_all(bd, '[{LATIN}][{LATIN}''-]{{2,}}') AS dl,
                list_distinct(list_transform(regexp_extract_all(bs, '[{LATIN}][{LATIN}''-]{{2,}}'), lambda w: lower(w))) AS sl
            FROM (SELECT *, coalesce(source, '') AS s, coalesce(translated, '') AS d, regexp_replace(coalesce(translated, ''), '(?i){PROTECTED_TOKEN}', ' ', 'g') AS bd,
                regexp_replace(coalesce(source, ''), '(?i){PROTECTED_TOKEN}', ' ', 'g') AS bs FROM v_pair))))""", "v_pair"))
def _(spark, sf):
    """All reasons but likeness, which SQL has no measure for."""
    out = pr.quality_gate(v.v_pair(spark, sf))
    return out.select("pair_id", F.array_join(F.filter("reasons", lambda r: r != "mostly_unchanged"), ",").alias("reasons"))


def _pairs(spark, sf):
    return v.v_pair(spark, sf).withColumn("seg_index", F.col("pair_id"))


STATE = """SELECT *, CASE WHEN src <> '' AND v <> '' AND reason <> 'ok' THEN 'invalid' WHEN src <> '' AND v = '' THEN 'missing'
        ELSE 'ok' END AS integrity FROM (SELECT *, {src} AS src FROM verdict)""".format(src=_strip("source"))


@register("integrity_rows", with_views("SELECT pair_id, integrity, reason FROM state", "v_pair",
                                       verdict=_verdict("translated", "source", "v_pair"), state=STATE))
def _(spark, sf):
    return pr.integrity_rows(_pairs(spark, sf)).select("pair_id", "integrity", "reason")


@register("integrity_gate", with_views("""
    SELECT media_id, count(*) FILTER (integrity = 'invalid') AS invalid_count, count(*) FILTER (integrity = 'missing') AS missing_count,
        coalesce(string_agg(CAST(pair_id AS VARCHAR), ',' ORDER BY pair_id) FILTER (integrity = 'missing'), '') AS missing_indices,
        coalesce(string_agg(pair_id || ':' || reason, ',' ORDER BY pair_id) FILTER (integrity = 'invalid' AND rn <= 2), '') AS invalid_samples,
        count(*) FILTER (integrity <> 'ok') > 0 AS blocked
    FROM (SELECT *, row_number() OVER (PARTITION BY media_id, integrity ORDER BY pair_id) AS rn FROM state) GROUP BY media_id""",
    "v_pair", verdict=_verdict("translated", "source", "v_pair"), state=STATE))
def _(spark, sf):
    shown = F.transform("invalid_samples", lambda s: F.concat_ws(":", s["seg_index"].cast("string"), s["reason"]))
    return pr.integrity_gate(_pairs(spark, sf), samples=2).withColumns({
        "invalid_samples": F.coalesce(F.array_join(shown, ","), F.lit("")),
        "missing_indices": F.array_join(F.transform("missing_indices", lambda i: i.cast("string")), ",")})


RESTORED = """SELECT *, CASE WHEN stored IS NULL THEN 'pending' WHEN reason = 'ok' THEN 'hit' ELSE 'rejected' END AS restore_status
        FROM verdict"""
STORED = "SELECT k.*, c.translated AS stored FROM v_key k LEFT JOIN v_ckpt c ON c.media_id = k.media_id AND c.key = k.segment_key"


@register("restore_checkpoint", with_views("""
    SELECT media_id, ord, segment_key, restore_status, length(CASE WHEN restore_status = 'hit' THEN v END) AS text_length
    FROM restored""", "v_key", "v_ckpt", joined=STORED, verdict=_verdict("stored", "text", "joined"), restored=RESTORED))
def _(spark, sf):
    out = pr.restore_checkpoint(v.v_seg(spark, sf), v.v_ckpt(spark, sf))
    return out.select("media_id", "ord", "segment_key", "restore_status", F.length("translated").alias("text_length"))


PACK = """,
    pnum AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_index) AS rn FROM todo),
    pack AS (SELECT media_id, rn, seg_index, 1::BIGINT AS batch_no, 1 AS n, size AS chars FROM pnum WHERE rn = 1
        UNION ALL
        SELECT t.media_id, t.rn, t.seg_index, CASE WHEN p.n >= 8 OR p.chars + t.size > 3900 THEN batch_no + 1 ELSE batch_no END,
               CASE WHEN p.n >= 8 OR p.chars + t.size > 3900 THEN 1 ELSE p.n + 1 END,
               CASE WHEN p.n >= 8 OR p.chars + t.size > 3900 THEN t.size ELSE p.chars + t.size END
        FROM pack p JOIN pnum t ON t.media_id = p.media_id AND t.rn = p.rn + 1)
"""


def _packed(body: str, *views: str, **more: str) -> str:
    return with_views("@@" + body, *views, **more).replace("\n@@", PACK)


@register("pack_batches", _packed("SELECT media_id, seg_index, batch_no FROM pack",
                                  todo="SELECT source AS media_id, doc_id AS seg_index, length(text) + 100 AS size FROM documents"))
def _(spark, sf):
    records = v.table(spark, sf, "documents").select(
        F.col("source").alias("media_id"), F.col("doc_id").alias("seg_index"), F.col("text").alias("source"))
    return pr.pack_batches(records).select("media_id", "seg_index", "batch_no")


@register("translation_plan", _packed("""
    SELECT media_id, count(*) FILTER (restore_status <> 'hit') AS pending, count(*) FILTER (restore_status = 'hit') AS hits,
        count(*) FILTER (restore_status = 'rejected') AS rejected,
        coalesce((SELECT max(batch_no) FROM pack p WHERE p.media_id = r.media_id), 0) AS batches
    FROM restored r GROUP BY media_id""", "v_key", "v_ckpt", joined=STORED, verdict=_verdict("stored", "text", "joined"),
    restored=RESTORED, todo="SELECT media_id, ord AS seg_index, length(text) + 100 AS size FROM restored WHERE restore_status <> 'hit'"))
def _(spark, sf):
    restored = pr.restore_checkpoint(v.v_seg(spark, sf), v.v_ckpt(spark, sf))
    todo = restored.filter("restore_status <> 'hit'").select(
        "media_id", F.col("ord").alias("seg_index"), F.col("text").alias("source"))
    return pr.translation_plan(restored, pr.pack_batches(todo))


@register("open_circuit", with_views("""
    SELECT media_id, batch_no, streak, coalesce(batch_no > min(CASE WHEN streak >= 2 THEN batch_no END) OVER (PARTITION BY media_id), false) AS deferred
    FROM (SELECT *, batch_no - coalesce(max(CASE WHEN NOT down THEN batch_no END) OVER (PARTITION BY media_id ORDER BY batch_no), 0) AS streak
          FROM (SELECT media_id, ord + 1 AS batch_no, length(text) % 3 > 0 AND role <> 'system' AS down FROM v_seg))""", "v_seg"))
def _(spark, sf):
    batches = v.v_seg(spark, sf).select(
        "media_id", (F.col("ord") + 1).alias("batch_no"), (F.length("text") % 3).alias("failed"),
        F.lit(0).alias("results"), (F.col("role") != "system").alias("temporary"))
    return pr.open_circuit(batches).select("media_id", "batch_no", "streak", "deferred")


@register("dedupe_deferred", """
    SELECT l_orderkey AS media_id, CAST(l_linenumber AS BIGINT) AS seg_index, l_partkey AS partkey, l_quantity AS quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    failures = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("bigint").alias("seg_index"),
        F.struct("l_shipdate", "l_partkey", "l_extendedprice").alias("ord"),
        F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"))
    return pr.dedupe_deferred(failures).drop("ord")


LOCAL_FIRST = """SELECT d.doc_id AS seg_index, d.source AS media_id, CASE WHEN d.lang <> 'es' AND n_chars > 2000 THEN 'local'
        WHEN l.quality = 1 THEN 'repair' WHEN d.lang = 'fr' THEN 'local_kept' ELSE 'failed' END AS origin,
        CASE WHEN d.lang <> 'es' AND n_chars > 2000 THEN length(CASE WHEN d.lang = 'fr' THEN text ELSE '' END)
             WHEN l.quality = 1 THEN 12 WHEN d.lang = 'fr' THEN length({t}) END AS text_length
        FROM documents d LEFT JOIN labels l USING (doc_id)""".format(t=_strip("text"))


def _merged(spark, sf):
    docs = v.table(spark, sf, "documents").withColumnsRenamed({"source": "media_id", "doc_id": "seg_index"})
    records = docs.select("media_id", "seg_index")
    local = docs.filter("lang <> 'es'").select(
        "media_id", "seg_index", F.expr("CASE WHEN lang = 'fr' THEN text ELSE '' END").alias("local_text"),
        (F.col("n_chars") > 2000).alias("local_ok"))
    repaired = (v.table(spark, sf, "labels").filter("quality = 1").withColumnRenamed("doc_id", "seg_index")
                .join(records, "seg_index").select("media_id", "seg_index", F.lit("repaired one").alias("repair_text")))
    return pr.merge_local_first(records, local, repaired)


@register("merge_local_first", with_views("SELECT * FROM m", m=LOCAL_FIRST))
def _(spark, sf):
    return _merged(spark, sf).select("media_id", "seg_index", "origin", F.length("translated").alias("text_length"))


@register("merge_summary", with_views("""SELECT media_id, count(*) AS segments, count(*) FILTER (origin = 'local') AS local,
    count(*) FILTER (origin = 'repair') AS repair, count(*) FILTER (origin = 'local_kept') AS local_kept,
    count(*) FILTER (origin = 'failed') AS failed FROM m GROUP BY media_id""", m=LOCAL_FIRST))
def _(spark, sf):
    return pr.merge_summary(_merged(spark, sf))


@register("apply_review", with_views("""SELECT pair_id, length(coalesce('Reviewed ' || l.quality, translated)) AS text_length
    FROM v_pair LEFT JOIN labels l ON l.doc_id = pair_id AND l.toxic = 1""", "v_pair"))
def _(spark, sf):
    edits = v.table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("pair_id"), F.concat(F.lit("Reviewed "), F.col("quality").cast("string")).alias("edited"))
    out = pr.apply_review(v.v_pair(spark, sf), edits, keys=("pair_id",))
    return out.select("pair_id", F.length("translated").alias("text_length"))


TOKEN = r"[\pL\pN_]+"


@register("apply_glossary", with_views(rf"""
    SELECT pair_id, CAST(count(source_term) AS INT) AS replacements,
        md5(string_agg(coalesce(target_term, t), '' ORDER BY n)) AS text_md5
    FROM (SELECT pair_id, t, n, g.* FROM tok LEFT JOIN (SELECT pair_id AS p, source_term, target_term FROM hits) g
          ON g.p = tok.pair_id AND g.source_term = lower(t)) GROUP BY pair_id""", "v_pair", "v_gloss",
    tok=rf"""SELECT pair_id, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM (
        SELECT pair_id, CASE WHEN translated = '' THEN [''] ELSE regexp_extract_all(translated, '{TOKEN}|[^\pL\pN_]+') END AS l FROM v_pair)""",
    hits=rf"""SELECT DISTINCT pair_id, source_term, target_term FROM (
        SELECT pair_id, unnest(regexp_extract_all(lower(source), '{TOKEN}')) AS w FROM v_pair) JOIN v_gloss ON w = source_term"""))
def _(spark, sf):
    gloss = v.v_gloss(spark, sf).withColumn("ord", F.lit(0).cast("bigint"))
    out = pr.apply_glossary(v.v_pair(spark, sf), gloss, keys=("pair_id",))
    return out.select("pair_id", "replacements", F.md5("translated").alias("text_md5"))


@register("vocabulary_prompt", with_views("@@SELECT prompt, CAST(n AS BIGINT) AS terms FROM walk ORDER BY rn DESC LIMIT 1", "v_gloss").replace("\n@@", """,
    ranked AS (SELECT source_term AS w, row_number() OVER (ORDER BY -length(source_term), source_term) AS rn FROM v_gloss),
    walk AS (SELECT 0::BIGINT AS rn, ''::VARCHAR AS prompt, 0 AS n
        UNION ALL SELECT r.rn, CASE WHEN ok THEN CASE WHEN n = 0 THEN w ELSE prompt || ', ' || w END ELSE prompt END,
                         CASE WHEN ok THEN n + 1 ELSE n END
        FROM (SELECT walk.*, r.rn AS nrn, length(prompt) + length(w) + CASE WHEN n > 0 THEN 2 ELSE 0 END <= 120 AND n < 16 AS ok
              FROM walk JOIN ranked r ON r.rn = walk.rn + 1) x JOIN ranked r ON r.rn = x.nrn)
    """))
def _(spark, sf):
    gloss = v.v_gloss(spark, sf).withColumn("ord", F.lit(0).cast("bigint"))
    return pr.vocabulary_prompt(gloss, max_chars=120, max_terms=16)


@register("provider_stats", with_views("""
    SELECT *, CASE WHEN gtts > 0 THEN 'mixed_gtts_fallback' ELSE 'selected_voice_only' END AS voice_consistency FROM (
    SELECT media_id, count(*) AS requested, count(tts_dur) AS created, 0 AS skipped, count(*) - count(tts_dur) AS failed,
        count(tts_dur) FILTER (provider = 'edge_tts') AS edge_tts, count(tts_dur) FILTER (provider = 'gtts') AS gtts,
        count(tts_dur) FILTER (provider = 'piper') AS piper FROM v_tts GROUP BY media_id)""", "v_tts"))
def _(spark, sf):
    return pr.provider_stats(v.v_tts(spark, sf))


@register("repair_candidates", with_views("""
    SELECT media_id, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord) AS rank FROM v_tts
        WHERE provider = 'gtts' AND tts_dur IS NOT NULL) WHERE rank <= 2
        AND media_id NOT IN (SELECT media_id FROM v_tts WHERE tts_dur IS NULL)""", "v_tts"))
def _(spark, sf):
    return pr.repair_candidates(v.v_tts(spark, sf), k=2).select("media_id", "ord", "rank")


def _items(spark, sf):
    seg = v.v_seg(spark, sf).withColumn("pack", F.floor(F.col("ord") / 8).cast("bigint"))
    item = F.struct(F.col("ord").alias("index"), "text")
    return seg.groupBy("media_id", "pack").agg(F.array_sort(F.collect_list(item)).alias("items"))


@register("marker_batches", with_views(rf"""
    SELECT media_id, ord // 8 AS pack, media_id % 7 <> 0 AS ok,
        CASE WHEN media_id % 7 = 0 THEN 'marker_missing_or_repeated' ELSE '' END AS error,
        CASE WHEN media_id % 7 <> 0 THEN sum(length({_strip('text')})) END AS text_length FROM v_seg
    GROUP BY media_id, ord // 8""", "v_seg"))
def _(spark, sf):
    sent = _items(spark, sf).withColumn("request", build_marker_batch(F.col("items")))
    reply = F.when(F.col("media_id") % 7 == 0, F.replace(F.col("request"), F.lit("_0001_END__"), F.lit(""))).otherwise(F.col("request"))
    parsed = sent.withColumn("p", parse_marker_batch(reply, F.col("items")))
    total = F.aggregate(F.map_values("p.texts"), F.lit(0), lambda a, x: a + F.length(x))
    return parsed.select("media_id", "pack", "p.ok", "p.error", total.cast("bigint").alias("text_length"))


NUM = r"\d+(?:(?:[.,:/-]\d+)|(?:[ \x{00A0}]\d{3}))*"
PROT = r"(?i)(?:https?://[^\s<>]+|www\.[^\s<>]+|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
TOKENS = f"""SELECT pair_id, kind, side, tok, count(*) AS n FROM (
        SELECT pair_id, 'num' AS kind, side, regexp_replace(unnest(regexp_extract_all(txt, '{NUM}')), '[^0-9]', '', 'g') AS tok FROM sides
        UNION ALL SELECT pair_id, 'prot', side, lower(rtrim(unnest(regexp_extract_all(txt, '{PROT}')), '.,;:!?)]}}')) FROM sides)
        WHERE tok <> '' GROUP BY ALL"""


@register("tokens_preserved", with_views("""
    SELECT pair_id, pair_id NOT IN (SELECT pair_id FROM lost WHERE kind = 'num') AS numbers_kept,
           pair_id NOT IN (SELECT pair_id FROM lost WHERE kind = 'prot') AS protected_kept FROM v_pair""", "v_pair",
    sides="SELECT pair_id, 's' AS side, source AS txt FROM v_pair UNION ALL SELECT pair_id, 't', translated FROM v_pair",
    tokens=TOKENS,
    lost="""SELECT s.pair_id, s.kind FROM (SELECT * FROM tokens WHERE side = 's') s LEFT JOIN (SELECT * FROM tokens WHERE side = 't') t
        ON t.pair_id = s.pair_id AND t.kind = s.kind AND t.tok = s.tok WHERE s.n > coalesce(t.n, 0)"""))
def _(spark, sf):
    src, dst = F.col("source"), F.col("translated")
    return v.v_pair(spark, sf).select(
        "pair_id", tokens_preserved(numeric_tokens(src), numeric_tokens(dst)).alias("numbers_kept"),
        tokens_preserved(protected_tokens(src), protected_tokens(dst)).alias("protected_kept"))


WORD = r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ſ]{3,}"


@register("shared_words", with_views(f"""
    SELECT pair_id, coalesce(n, 0) AS shared FROM v_pair LEFT JOIN (SELECT pair_id, count(*) AS n FROM (
        SELECT pair_id, lower(unnest(regexp_extract_all(translated, '{WORD}'))) AS w FROM v_pair) t
        WHERE length(w) > 3 AND w NOT IN ('http', 'html') AND EXISTS (SELECT 1 FROM src WHERE src.pair_id = t.pair_id AND src.w = t.w)
        GROUP BY pair_id) USING (pair_id)""", "v_pair",
    src=f"SELECT DISTINCT pair_id, lower(unnest(regexp_extract_all(source, '{WORD}'))) AS w FROM v_pair"))
def _(spark, sf):
    def words(c):
        return F.regexp_extract_all(F.col(c), F.lit(f"([{LATIN}]{{3,}})"), F.lit(1))
    return v.v_pair(spark, sf).select("pair_id", F.size(shared_words(
        words("source"), words("translated"), ["http", "html"])).cast("bigint").alias("shared"))


@register("apply_backends")
def _(spark, sf):
    docs = v.v_seg(spark, sf).select("media_id", "ord", "text")

    def first(texts, src, tgt):
        return [t.upper() if len(t) % 3 else "" for t in texts]

    def second(texts, src, tgt):
        return [t.lower() for t in texts]

    out = pr.apply_backends(docs, [("first", first), ("second", second)], "text", "en", "ru")
    return out.select("media_id", "ord", "backend", "confidence", F.length("translated").alias("text_length"))


@register("review_round_trip", with_views(rf"""
    SELECT media_id, ord + 1 AS seg_index, length({_strip("lower(text)")}) AS text_length FROM v_seg""", "v_seg"))
def _(spark, sf):
    pairs = v.v_seg(spark, sf).select("media_id", (F.col("ord") + 1).alias("seg_index"), "start", "end",
                                      F.col("text").alias("source"), F.lower("text").alias("translated"))
    edits = rv.import_review(rv.export_review(pairs))
    return pr.apply_review(pairs, edits).select("media_id", "seg_index", F.length("translated").alias("text_length"))


@register("default_language", """
    SELECT c_custkey, coalesce(n.n_name, f.n_name) AS label, coalesce(n.n_regionkey, f.n_regionkey) AS code FROM customer
    LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_nationkey % 3 > 0 JOIN nation f ON f.n_nationkey = 1""")
def _(spark, sf):
    nations = v.table(spark, sf, "nation").filter("n_nationkey % 3 > 0").select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("code"))
    names = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    requests = v.table(spark, sf, "customer").join(names, "c_nationkey").select("c_custkey", "label")
    fallback = v.table(spark, sf, "nation").filter("n_nationkey = 1").first().n_name
    return pr.default_language(nations, requests, fallback).select("c_custkey", "label", "code")
