"""Quality rules per document, and verdicts on hosts from shrunken failure rates.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage, let

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _next(array: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _window_hashes(words: Column) -> Column:
    """A hash of every 8 consecutive words, by doubling: 1, 2, 4, 8 words."""
    pair = lambda by: lambda h: F.zip_with(h, _next(h, by), lambda a, b: F.xxhash64(a, b))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        hashed = let(hashed, pair(by))
    return let(hashed, lambda h: F.slice(h, 1, F.greatest(F.size(h) - 7, F.lit(0))))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, the first occurrence included."""
    def marked(s: Column) -> Column:
        same = lambda p, q: F.coalesce(q["h"] == p["h"], F.lit(False))
        return F.filter(F.transform(s, lambda p, i: F.when(same(p, F.get(s, i - 1)) | same(p, F.get(s, i + 1)), p["i"])), lambda i: i.isNotNull())

    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = let(F.array_sort(let(order, marked)), lambda p: F.zip_with(p, _next(p, 1), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeat_words(words: Column) -> Column:
    repeats = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))
    return let(words, lambda ws: F.when(F.size(ws) < 9, F.lit(0)).otherwise(let(_window_hashes(ws), repeats)))


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def rule_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``METRICS`` (long) and ``base_failed``.

    Words are runs without the six ASCII white-space characters; a null text has none.
    ``n_repeat_words`` counts words in 8-word windows that the text has twice or more.
    ``base_failed``: under 20 words, or over 30 in 100 words repeated.  Columns of ``docs``
    with these names give way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    counted = docs.drop(*METRICS, "base_failed").select("*", F.struct(
        let(words, lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r"))).alias("w"),
        let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d"))).alias("l"),
        _length_without(text, " \t\n\x0b\x0c\r").alias("c"),
        (F.length(text) - _length_without(text, "#*$%&|<>")).alias("s")).alias("_m"))
    m = lambda path: F.col(f"_m.{path}").cast("long")
    return counted.select(
        *[F.col(c) for c in counted.columns if c != "_m"], m("w.n").alias("n_words"), m("c").alias("word_chars"), m("s").alias("n_symbols"),
        m("l.n").alias("n_lines"), m("l.d").alias("n_dup_lines"), m("w.r").alias("n_repeat_words"),
        ((m("w.n") < 20) | (100 * m("w.r") > 30 * m("w.n"))).alias("base_failed"))


@dataclass(frozen=True)
class Limits:
    """Limits of the rules that a host is judged by, in parts of a hundred unless said otherwise."""
    symbols: int = 10        # symbols to words
    dup_lines: int = 30      # repeated lines to lines
    shortest: int = 2        # mean characters of a word, at least
    longest: int = 12        # and at most
    host_rate: float = 0.5   # a host whose shrunken failure rate is above is rejected
    strongest: float = 1000  # the prior weighs at most so many documents


def failed(limits: Limits) -> Column:
    """Whether a document fails any rule."""
    n = F.col("n_words")
    return (F.col("base_failed") | (100 * F.col("n_symbols") > limits.symbols * n) | (100 * F.col("n_dup_lines") > limits.dup_lines * F.col("n_lines"))
            | (F.col("word_chars") < limits.shortest * n) | (F.col("word_chars") > limits.longest * n))


def host_verdicts(measured: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per host: documents, failures, shrunken rate and ``host_rejected``.

    The failure rates of all hosts have a beta prior, fitted by moments: mean m of all
    documents, variance between hosts beyond what binomial chance gives.  The shrunken rate
    is (failures + a) / (documents + a + b).  Rows with a null host are left out.  The
    counts are summed map-side first, so a host with a third of all rows is no hot key;
    the driver gets one row of sums.
    """
    hosts = cut_lineage(measured.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(failed(limits).cast("long")).alias("host_failures")))
    rate = F.col("host_failures") / F.col("host_docs")
    n, k, squares, h = hosts.agg(F.sum("host_docs"), F.sum("host_failures"), F.sum(F.col("host_docs") * rate * rate), F.count(F.lit(1))).first()
    mean = (k or 0) / n if n else 0.0
    spread = max(0.0, (squares / n - mean * mean) - mean * (1 - mean) * (h - 1) / n) if n else 0.0
    strength = limits.strongest if mean * (1 - mean) >= (limits.strongest + 1) * spread else max(1.0, mean * (1 - mean) / spread - 1)
    shrunk = (F.col("host_failures") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select(host, "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk > limits.host_rate).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Metrics and verdict of every row: ``doc_id``, the host, ``METRICS``, ``base_failed``, ``kept``.

    A document is kept unless it fails the base rules or its host is rejected.  Documents
    without a host are judged alone.  The texts are read once; the numbers are written
    to the shared folder, and hosts are counted from and joined to them.
    """
    measured = cut_lineage(rule_metrics(docs.select("doc_id", F.col(host), "text")).drop("text"))
    verdicts = cut_lineage(host_verdicts(measured, host, limits).filter("host_rejected").select(host, "host_rejected"))
    return measured.join(verdicts, host, "left").select(
        "doc_id", host, *METRICS, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns as they are."""
    measured = cut_lineage(rule_metrics(docs.select(F.col(host), "text")).drop("text"))
    rejected = cut_lineage(host_verdicts(measured, host, limits).filter("host_rejected").select(F.col(host).alias("_host")))
    judged = rule_metrics(docs.select(F.struct("*").alias("_row"), "text")).filter(~F.col("base_failed")).select("_row.*")
    return judged.join(rejected, judged[host] == F.col("_host"), "left_anti")
