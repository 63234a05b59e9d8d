"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: The item that stands for a bad label in a transaction; a URL token never looks so.
_BAD = "label=bad"


@dataclass(frozen=True)
class Fixed:
    """A verdict on a host, its subdomains and the paths that start so: ``net/es/``."""
    verdict: str
    rule: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


#: The rules every crawl starts from.
FIXED = (Fixed("allow", "com/"), Fixed("block", "example.com/en/"), Fixed("allow", "www.example.com/en/"), Fixed("block", "net/es/"), Fixed("block", "net/fr/"))


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased), ``path`` and ``tokens`` of ``url``.

    A null url, or one without ``://``, has an empty host and path and no tokens.  Tokens
    are the host's labels and their parts, words of the path with numbers as ``#``, and
    names of query fields; each once, with a mark of where it stands.
    """
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    base = pages.drop("host", "path", "tokens").withColumn("_rest", F.coalesce(rest, F.lit("")))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("_rest", r"\?([^#]*)", 1)
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    words = F.split(F.regexp_replace(F.translate("path", upper, lower), "[0-9]+", "#"), r"[^a-z#\x{80}-\x{10FFFF}]+")
    tokens = F.concat(marked("h:", F.split("host", r"\.")), marked("w:", F.split("host", r"[.-]")), marked("p:", words),
                      marked("q:", F.split(F.regexp_replace(query, "=[^&]*", ""), "&")))
    return (base.withColumn("host", host).withColumn("path", path).withColumn("tokens", F.array_sort(F.array_distinct(tokens))).drop("_rest"))


def token_classes(labelled: DataFrame, min_count: int = 20) -> DataFrame:
    """Tokens that may be in a rule: ``token``, its class ``item``, ``n`` rows with it and ``hits`` bad ones, from ``tokens`` and ``bad``.

    A rule's tokens all have ``min_count`` bad rows.  Tokens of the very same rows are one class, named after its
    least token: thirty fields that always come together count as one.
    """
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("_row"), "tokens", "bad"))
    counts = rows.select("_row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"),
        *[F.sum(F.xxhash64("_row", F.lit(k)).cast("decimal(38,0)")).alias(f"_s{k}") for k in (0, 1)])
    same = ["n", "hits", "_s0", "_s1"]
    useful = cut_lineage(counts.filter(F.col("hits") >= min_count))
    return cut_lineage(useful.join(useful.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "n", "hits"))


def _classed(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the classes ``items`` (distinct) of every row that has some, from its ``tokens``."""
    return (rows.select(*keys, F.explode("tokens").alias("token")).join(classes, "token")
            .groupBy(*keys).agg(F.collect_set("item").alias("items")))


def _indexed(sets: DataFrame) -> DataFrame:
    """``sets`` with one of their ``items`` as ``token``, the one in fewest sets: an inverted index."""
    entries = sets.select("items", F.explode("items").alias("token"))
    weight = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = entries.join(weight, "token").groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return cut_lineage(sets.join(index, "items"))


def mine_rules(labelled: DataFrame, min_support: float = 0.0, min_count: int = 20, min_confidence: float = 0.5, classes: DataFrame | None = None) -> DataFrame:
    """Rules ``items`` => bad, with ``confidence`` and ``support``, from ``tokens`` and boolean ``bad``.

    A rule is right in at least ``min_count`` rows at every size of the table (and in a share ``min_support``, where one is asked for)
    and in a share ``min_confidence`` of the rows that it fits, and does better than chance and than every rule with one item fewer.
    Items are token classes (``token_classes``).  FP-growth mines the bad rows alone, and finds all sets of
    items there, however many a row has.  Two kinds of items stay out, as no rule needs them in a set: one whose
    rows are all bad is right alone, and one that all rows have tells nothing.  What the sets found are worth is
    then counted over all rows.  No rows or no bad rows: no rules.

    All sets are a matter of the data: many items that often, but not always, come together in bad and good
    rows have exponentially many.  They pass as rows of a table, in no task's or the driver's memory.
    """
    spark = labelled.sparkSession
    n, bad = labelled.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    least = max(min_count, -int(-min_support * n // 1))
    none = spark.createDataFrame([], "items array<string>, confidence double, support double")
    if (bad or 0) < least:
        return none
    classes = token_classes(labelled, least) if classes is None else classes
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("_row"), "tokens", "bad"))
    held = cut_lineage(_classed(rows, classes, ["_row", "bad"]))
    telling = cut_lineage(classes.groupBy("item").agg(F.max("n").alias("n"), F.max("hits").alias("hits")).filter((F.col("n") < n) & (F.col("hits") >= least)))
    mixed = held.filter("bad").select("_row", F.explode("items").alias("item")).join(telling.filter("hits < n").select("item"), "item")
    first = cut_lineage(mixed.groupBy("_row").agg(F.collect_list("item").alias("items")).select("items"))
    sets, seen = telling.filter("hits = n").select(F.array("item").alias("items")), first.count()
    if seen >= least:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / seen, minConfidence=min_confidence)
        sets = sets.unionByName(model.fit(first).freqItemsets.select(F.array_sort("items").alias("items")))
    index = _indexed(cut_lineage(sets))
    fitting = held.select("bad", F.col("items").alias("_has"), F.explode("items").alias("token")).join(index, "token").filter(F.size(F.array_except("items", "_has")) == 0)
    worth = fitting.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"))
    rules = worth.select("items", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"))
    rules = cut_lineage(rules.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") > bad / n)))
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("other"))
    parts = rules.select("items", "confidence", F.explode("items").alias("item")).select("items", "confidence", F.array_remove("items", F.col("item")).alias("part"))
    beaten = parts.join(shorter, "part").filter(F.col("other") >= F.col("confidence")).select("items").distinct()
    return rules.join(beaten, "items", "left_anti")


def match_rules(tokens: DataFrame, rules: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(tokens, confidence) of every distinct ``tokens`` array that a rule fits, with its best confidence.

    Every rule stands in an inverted index under one of its items, the one in fewest rules;
    a token list looks up its items there and keeps the rules whose items it has all.  With ``classes`` a list has an item if it has any token
    of that class.
    """
    index = _indexed(rules.select("items", "confidence"))
    lists = tokens.select("tokens").distinct()
    if classes is None:
        lists = lists.select("tokens", F.col("tokens").alias("_has"))
    else:
        lists = _classed(lists, classes, ["tokens"]).select("tokens", F.col("items").alias("_has"))
    lookups = lists.select("tokens", "_has", F.explode("_has").alias("token"))
    fitting = lookups.join(index, "token").filter(F.size(F.array_except("items", "_has")) == 0)
    return fitting.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labelled: DataFrame, fixed: tuple[Fixed, ...] = FIXED, **mining) -> DataFrame:
    """Verdict on every page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``confidence``.

    The longest fixed rule that fits decides; ``rule`` is null where none does, and the
    verdict is then ``block`` if a mined rule fits the URL's tokens, else ``allow``.
    ``labelled`` has ``url`` and boolean ``bad`` (null: not labelled).  Repeated pages each get
    a row; URLs with the same tokens are looked up once.
    """
    learn = with_parts(labelled.select("url", "bad").filter(F.col("bad").isNotNull() & F.col("url").isNotNull()))
    split = with_parts(pages.select("page_id", "url"))
    learn = cut_lineage(learn.select("tokens", "bad"))
    classes = token_classes(learn, mining.get("min_count", 20))
    found = cut_lineage(match_rules(split, cut_lineage(mine_rules(learn, classes=classes, **mining)), classes))
    ranked = sorted(fixed, key=lambda f: len(f.rule), reverse=True)
    chosen = F.coalesce(*[F.when(f.fits(F.col("host"), F.col("path")), F.struct(F.lit(f.rule).alias("rule"), F.lit(f.verdict).alias("verdict"))) for f in ranked])
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return (split.withColumn("_fixed", chosen).join(found, "tokens", "left")
            .select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce(F.col("_fixed.verdict"), mined).alias("verdict"), "confidence"))
