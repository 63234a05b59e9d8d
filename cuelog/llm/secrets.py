"""Secret scans: trigram queries derived from each rule pick candidates from an inverted index.

DataFrame functions only; the rules' regular expressions are read on the driver when the
plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

#: Longest list of strings that a part of a pattern is spelled out into.
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A match counts if group ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False


#: The base kinds, in the order that breaks ties, then the added ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, False, True),
    Rule("hex", "[0-9a-f]+", 0, 16, False, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("dsn", r"(postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20:/@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]+"),
)

Clause = frozenset  # of alternatives, each a frozenset of trigrams


def _trigrams(text: str) -> frozenset:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Clause | None:
    """Any of the strings occurs: one alternative each, without those that another implies."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    ways = {_trigrams(s) for s in strings}
    return frozenset(w for w in ways if not any(v < w for v in ways))


def trigram_query(rule: Rule) -> list[Clause]:
    """What every match must contain: all clauses, of each one alternative, of that all trigrams.

    An empty list says that nothing is mandatory, and the rule scans every text.  Literals
    and small classes are spelled out and joined to their neighbours; a part of unknown
    content ends the string.  Rules in any case look at lower-cased text.
    """
    clauses: list[Clause] = []

    def end(strings: set[str]) -> set[str]:
        found = _clause(strings)
        if found:
            clauses.append(found)
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if they are few."""
        strings = {""}
        for kind, value in items:
            part = spelled(kind, value)
            if part is None or len(part) * len(strings) > _MOST:
                return None
            strings = {s + p for s in strings for p in part}
        return strings

    def spelled(kind, value) -> set[str] | None:
        if kind is rc.LITERAL:
            return {chr(value)}
        if kind is rc.IN:
            few = {chr(v) for k, v in value if k is rc.LITERAL}
            return few if all(k is rc.LITERAL for k, _ in value) and len(few) <= 4 else None
        if kind is rc.SUBPATTERN:
            return exact(value[-1])
        if kind is rc.BRANCH:
            ways = [exact(way) for way in value[1]]
            return None if any(w is None for w in ways) else set().union(*ways)
        if kind is rc.MAX_REPEAT and value[1] == 1:
            part = exact(value[2])
            return None if part is None else part | ({""} if value[0] == 0 else set())
        if kind is rc.MAX_REPEAT and value[0] == value[1] <= 8:
            return exact(list(value[2]) * value[0])
        return None

    def walk(items, strings: set[str]) -> set[str]:
        for kind, value in items:
            part = spelled(kind, value)
            if part is not None:
                if len(part) * len(strings) > _MOST:
                    strings = end(strings)
                strings = {s + p for s in strings for p in part}
            elif kind is rc.SUBPATTERN:
                strings = walk(value[-1], strings)
            else:
                strings = end(strings)
        return strings

    end(walk(rp.parse(rule.pattern), {""}))
    if rule.any_case:
        clauses = [frozenset(frozenset(t.lower() for t in way) for way in c) for c in clauses]
    return list(dict.fromkeys(clauses))


def postings(docs: DataFrame, wanted: dict[str, tuple[bool, str]]) -> DataFrame:
    """The inverted index, of the wanted trigrams only: (trigram, doc_id), one row each.

    ``wanted`` maps the name of a trigram to (looked for in lower-cased text?, trigram).
    """
    texts = docs.select("doc_id", "text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("lowered"))
    found = [F.when(F.contains(F.col("lowered" if low else "text"), F.lit(t)), F.lit(name)) for name, (low, t) in wanted.items()]
    return texts.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the indexed rules whose trigram query a document's postings satisfy.

    Postings of one document meet map-side, so nothing large is shuffled; a document id
    appears once, whatever the number of its rows.
    """
    queries = {r.kind: (r.any_case, q) for r in rules if (q := trigram_query(r))}
    spelled = lambda low, t: f"l:{t}" if low else f"x:{t}"
    wanted = sorted({(low, t) for low, q in queries.values() for c in q for way in c for t in way})
    if not wanted:
        return docs.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    index = postings(docs, {spelled(low, t): (low, t) for low, t in wanted})
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    has = lambda way, low: reduce(lambda a, b: a & b, [F.array_contains("held", spelled(low, t)) for t in sorted(way)])
    meets = lambda low, q: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(way, low) for way in c]) for c in q])
    kinds = F.array_compact(F.array(*[F.when(meets(low, q), F.lit(kind)) for kind, (low, q) in queries.items()]))
    return held.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def find_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's leftmost non-overlapping matches as (start, rank, kind, end), code points.

    Matches and the gaps between them alternate, so their lengths add up to the places.
    """
    pattern = F.lit(_regex(rule))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(F.transform(F.split(text, _regex(rule), -1), lambda g: F.length(g)).alias("gap"),
                         F.transform(whole, lambda m: F.length(m)).alias("match"),
                         F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g)).alias("held"))
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        last = begin + F.coalesce(p["match"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), last.alias("end"))
        spans = F.when(p["held"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(last.alias("at"), spans.cast(_SPAN).alias("spans"))

    return F.when(text.rlike(_regex(rule)), F.aggregate(parts, start, add)["spans"]).otherwise(none)


def _regex(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + rule.pattern


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` and ``secrets``: all spans of every row's text, by start, then kind as listed.

    Rules with mandatory trigrams are verified on the documents that the inverted index
    offers; the others scan every text.  Null texts have no spans.  Candidates are joined by
    ``doc_id`` (null-safe); ids that several rows share only make more rows candidates.
    """
    indexed = {r.kind for r in rules if trigram_query(r)}
    offered = cut_lineage(candidates(docs.select("doc_id", "text"), rules)).select(F.col("doc_id").alias("_doc"), F.col("kinds").alias("_kinds"))
    base = docs.drop("secrets")
    joined = base.join(offered, base["doc_id"].eqNullSafe(F.col("_doc")), "left").withColumn("_text", F.coalesce("text", F.lit("")))
    found = [F.when(F.array_contains("_kinds", r.kind), find_spans(F.col("_text"), r, k)).otherwise(F.array().cast(_SPAN)) if r.kind in indexed
             else find_spans(F.col("_text"), r, k) for k, r in enumerate(rules)]
    return joined.withColumn("secrets", F.array_sort(F.concat(*found))).drop("_doc", "_kinds", "_text")


def spelled_out(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; overlapping spans become one."""
    scanned = scan_secrets(docs, rules)

    def step(text: Column):
        def take(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            gap = F.when(fresh, F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))
        return take

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    clean = F.aggregate("secrets", start, step(text), lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return scanned.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(text)).select(docs.columns)
