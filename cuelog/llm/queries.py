"""The registered queries of the operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations as _conversations
from . import decontaminate as _decontaminate
from . import html_template as _html_template
from . import jaccard as _jaccard
from . import language as _language
from . import merkle as _merkle
from . import packing as _packing
from . import quality as _quality
from . import secrets as _secrets
from . import suffix_array as _suffix_array
from . import suffix_trees as _suffix_trees
from . import token_counts as _token_counts
from . import twins as _twins
from . import url_rules as _url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(_twins.LEAKS)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of test items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).drop("text", "hit_spans")


@_query(r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: md5_number(array_to_string(ws[i:i + 7], ' ')))) AS g FROM w WHERE len(ws) >= 9),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM p),
s AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM g WHERE c >= 2),
r AS (SELECT rid, sum(step)::BIGINT AS n_repeat_words FROM s GROUP BY rid),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
             OR word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT)::DOUBLE AS k FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS h, sum(k * k / n) AS squares FROM h),
v AS (SELECT mean, greatest(0, squares / n - mean * mean - mean * (1 - mean) * (h - 1) / n) AS spread FROM t),
a AS (SELECT mean, CASE WHEN mean * (1 - mean) >= 1001 * spread THEN 1000 ELSE greatest(1, mean * (1 - mean) / spread - 1) END AS strength FROM v),
x AS (SELECT source FROM h, a WHERE (k + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(source NOT IN (SELECT source FROM x), true) AS kept FROM b""")
def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rules, and hosts judged by shrunken failure rates."""
    judged = _quality.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.drop("source", "n_lines")


@_query()
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL.

    Labels are those of the document that a page shows, whose number is the last number in
    the URL's path; toxic or low-quality documents make a page bad.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/0-9]*/?([?#].*)?$', 1) AS bigint)").alias("doc_id"))
    return _url_rules.url_filter(pages, shown.join(labels, "doc_id").select("url", "bad"))


@_query(_twins.secrets_sql())
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as counts, digest and spans."""
    found = _secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [r.kind for r in _secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(_secrets.spelled_out(F.filter("secrets", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), _secrets.spelled_out(F.col("secrets")).alias("spans"))


@_query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dictionaries = _language.train(docs.filter(~F.col("held_out")))
    return _language.identify(docs.select("doc_id", "text", "held_out"), dictionaries).drop("text")


@_query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    import public_tokenizers
    return _packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated 200-byte strings."""
    left = _suffix_array.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query(_twins.PASSAGES)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without 13-word passages of earlier ones."""
    left = _suffix_trees.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query(_twins.groups_sql(4, 85))
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are 85 in 100 the same."""
    return _jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@_query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return _html_template.extract_text(_table(spark, sf_dir, "pages"))


@_query(_twins.manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that a tampered text folds to."""
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(touched, _merkle.leaf_of(*fields, F.translate("text", "\n", "")))
    made = _merkle.manifest(docs, _merkle.leaf_of(*fields, F.col("text")), tampered=tampered)
    proved = made.select("doc_id", "leaf", "subroot", "root", F.sha2(_merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                         _merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    import public_tokenizers
    return _token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query(_twins.repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    rows = _table(spark, sf_dir, "conversations")
    return _conversations.repaired(_conversations.damage(rows), rows)
