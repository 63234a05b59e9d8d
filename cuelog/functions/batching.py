"""Several texts in one request: numbered marker lines, and strict reading of the reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def _nonce(items: Column) -> Column:
    lines = F.transform(items, lambda i: F.concat(i["index"].cast("string"), F.lit(":"), i["text"]))
    return F.upper(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 10))


def _markers(items: Column, prefix: str) -> Column:
    """[{index, text, open, close}] for an array of {index, text}."""
    def mark(nonce, item, position):
        stem = F.concat(F.lit(f"__{prefix}_"), nonce, F.lit("_"), F.lpad((position + 1).cast("string"), 4, "0"))
        return F.struct(item["index"].alias("index"), item["text"].alias("text"),
                        F.concat(stem, F.lit("_START__")).alias("open"), F.concat(stem, F.lit("_END__")).alias("close"))
    return let(lambda v: F.transform(v["items"], lambda item, i: mark(v["nonce"], item, i)),
               items=items, nonce=_nonce(items))


def build_marker_batch(items: Column, prefix: str = "SEG") -> Column:
    """Request text holding every item between its own pair of markers."""
    return F.array_join(F.transform(_markers(items, prefix), lambda m: F.concat_ws(
        "\n", m["open"], strip(m["text"]), m["close"])), "\n")


def _count(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def parse_marker_batch(reply: Column, items: Column, prefix: str = "SEG") -> Column:
    """Struct (ok, error, texts map index -> text) of a reply to :func:`build_marker_batch`.

    Every marker must stand there once, in order, with a text inside and nothing
    but white space between the blocks.
    """
    return let(lambda v: _parse(v["reply"], v["markers"]), reply=F.coalesce(reply, F.lit("")),
               markers=_markers(items, prefix))


def _parse(reply: Column, markers: Column) -> Column:
    entry = "array<struct<index:bigint,text:string>>"

    def step(state, m):
        start, end = F.position(m["open"], reply), F.position(m["close"], reply)
        inside = strip(F.substr(reply, start + F.length(m["open"]),
                                F.greatest(F.lit(0), end - start - F.length(m["open"]))))
        gap = strip(F.substr(reply, state["at"], F.greatest(F.lit(0), start - state["at"])))
        error = (F.when(state["error"] != "", state["error"])
                 .when((_count(reply, m["open"]) != 1) | (_count(reply, m["close"]) != 1), F.lit("marker_missing_or_repeated"))
                 .when((start < state["at"]) | (gap != ""), F.lit("start_marker_out_of_place"))
                 .when(end < start, F.lit("end_marker_missing"))
                 .when(inside == "", F.lit("empty_text"))
                 .otherwise(""))
        return F.struct(
            error.alias("error"), (end + F.length(m["close"])).cast("int").alias("at"),
            F.concat(state["texts"], F.array(F.struct(m["index"].cast("bigint").alias("index"), inside.alias("text")))
                     ).cast(entry).alias("texts"))

    first = F.struct(F.lit("").alias("error"), F.lit(1).alias("at"), F.array().cast(entry).alias("texts"))

    def finish(state):
        rest = strip(F.substr(reply, state["at"]))
        error = F.when((state["error"] == "") & (rest != ""), F.lit("text_after_last_marker")).otherwise(state["error"])
        good = error == ""
        return F.struct(good.alias("ok"), error.alias("error"),
                        F.when(good, F.map_from_entries(state["texts"])).alias("texts"))

    return F.aggregate(markers, first, step, finish)
