"""Greedy left-to-right grouping that stays parallel on a huge key.

A greedy rule ("keep adding rows to the group until the rule says stop") looks
sequential.  But where a group that starts at row i ends depends on row i and
what follows only, so every row has a fixed *next start*; the groups are the
chain 1 -> next(1) -> next(next(1)) ...  Each block of rows finds its rows' next
starts on its own (it also sees the first rows of the blocks after it).  A block
is entered only at the few rows the block before jumps to, so it sums up as a
small entry -> exit table, and one key's chain runs over those tables alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import Scan, ordered_scan, row_number, running_sum

#: Islands of a key that one task takes together.
ISLANDS = 4096


def island_groups(df: DataFrame, keys: list[str], order: list[str], block: Column, seen: Scan, fresh: Callable[[Column], Column],
                  rule_columns: list[str], begin: Callable[..., tuple], advance: Callable[..., tuple | None]) -> DataFrame:
    """Add ``group_start`` (position of the group's first row) and ``position``, for a rule whose groups never cross an island's edge.

    ``fresh(seen)`` tells from one scan over the earlier rows that no group can reach this row from before, whichever row that group
    began with: here an island begins.  Islands need nothing of each other, so a key is dealt over tasks by its islands,
    ``ISLANDS`` at a time, and each is worked through once in order: ``begin(*columns)`` gives the state of a group that begins
    with a row, ``advance(state, *columns)`` the state with one more row, or None if that row begins the next group.  A state is all
    that is held, so a group of any length costs a step a row.
    """
    rows = df.drop("position", "group_start")
    placed = ordered_scan(rows.withColumn("_span", block), keys, order, "_span", position=row_number(), _seen=seen)
    edge = F.coalesce((F.col("position") == 1) | fresh(F.col("_seen")), F.lit(True))
    cut = ordered_scan(placed.withColumn("_fresh", edge).drop("_seen"), keys, order, "_span", _island=running_sum(F.col("_fresh").cast("bigint")))
    chunk = F.floor(F.col("_island") / ISLANDS).cast("bigint").alias("_chunk")
    dealt = cut.select("*", chunk).drop("_island", "_span").repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, start = None, 0
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            values = list(zip(*[column(c).to_pylist() for c in rule_columns], strict=True))
            edges, positions = column("_fresh").to_pylist(), column("position").to_pylist()
            starts = []
            for k, value in enumerate(values):
                state = None if edges[k] else advance(state, *value)
                if state is None:
                    state, start = begin(*value), positions[k]
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "group_start"])

    made = dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("group_start", T.LongType())]))
    return made.select(*rows.columns, "position", "group_start")


def greedy_groups(df: DataFrame, keys: list[str], order: list[str], block: Column,
                  rule_columns: list[str], group_end: Callable[..., int],
                  block_rows: int = 8192, look_ahead: int = 256, longest: int | None = None) -> DataFrame:
    """Add ``group_start`` (position of the group's first row) and ``position``.

    ``group_end(i, n, *columns)`` gets the rule columns as numpy arrays and
    returns the index of the first row not in the group that starts at ``i``
    (``n`` if the group takes all rows given).  ``block`` cuts the order axis
    for the numbering, as in :func:`ordered_scan`.

    Blocks hold positions and rule columns only; the rows themselves are joined back.
    A block sees ``look_ahead`` rows of those after it.  Where a group reaches
    beyond them, the blocks are built again with eight times as many, so the answer does
    not depend on either number.  A rule that never takes more than ``longest`` rows says so: one building is enough then.
    For rules with natural breaks between rows see :func:`island_groups`.
    """
    look_ahead = longest or look_ahead
    numbered = ordered_scan(df.drop("position", "group_start"), keys, order, block, position=row_number())
    narrow = numbered.select(*keys, "position", *[c for c in rule_columns if c not in keys])
    while True:
        blocks = cut_lineage(_blocks(narrow, keys, rule_columns, group_end, block_rows, look_ahead))
        unfinished = longest is None and blocks.agg(F.max(F.exists("_next", lambda n: n < 0))).first()[0]
        if not unfinished:
            break
        look_ahead *= 8

    first = F.struct(F.lit(1).cast("bigint").alias("entry"), F.lit(None).cast("bigint").alias("spill"))
    chained = _block_entries(blocks, keys, block_rows)
    entered = (blocks.join(chained, [*keys, "_blk"], "left")
               .withColumn("_in", F.when(F.col("_blk") == 0, first).otherwise(F.col("_in"))))

    @F.pandas_udf("array<bigint>")
    def starts(blk: pd.Series, nexts: pd.Series, entry: pd.Series, spill: pd.Series) -> pd.Series:
        out = []
        for b, nxt, e, s in zip(blk, nexts, entry, spill):
            base = b * block_rows + 1
            nxt = np.asarray(nxt, dtype=np.int64)
            marks = np.zeros(len(nxt), dtype=np.int64)
            pos = int(e) if e == e and e is not None else base + len(nxt)
            if s == s and s is not None:
                marks[: max(0, pos - base)] = int(s)
            while pos - base < len(nxt):
                end = int(nxt[pos - base])
                marks[pos - base: min(end - base, len(nxt))] = pos
                pos = end
            out.append(marks)
        return pd.Series(out)

    marked = entered.withColumn(
        "_start", starts("_blk", "_next", F.col("_in.entry"), F.col("_in.spill")))
    found = marked.select(*keys, (F.col("_blk") * block_rows + 1).alias("_base"), F.posexplode("_start").alias("_at", "group_start"))
    starts_of = found.select(*keys, (F.col("_base") + F.col("_at")).alias("position"), "group_start")
    return numbered.join(starts_of, [*keys, "position"]).select(*[c for c in numbered.columns if c != "position"], "position", "group_start")


def _blocks(narrow: DataFrame, keys: list[str], rule_columns: list[str], group_end: Callable[..., int], block_rows: int, look_ahead: int) -> DataFrame:
    """A row per (key, block): where the group of each of its rows would end, as the position of the next start.

    -1 says that the block does not see far enough.
    """
    own = F.floor((F.col("position") - 1) / block_rows).cast("bigint")
    back = F.floor((F.col("position") - 1 - look_ahead) / block_rows).cast("bigint")
    rules = [c for c in rule_columns if c not in keys]
    blocks = (
        narrow.withColumn("_blk", F.explode(F.sequence(F.greatest(F.lit(0), back), own)))
        .groupBy(*keys, "_blk")
        .agg(F.array_sort(F.collect_list(F.struct("position", *rules))).alias("_rows"), F.count_if(own == F.col("_blk")).alias("_own"))
        .filter("_own > 0")
    )

    @F.pandas_udf("array<bigint>")
    def next_starts(blk: pd.Series, own: pd.Series, *columns: pd.Series) -> pd.Series:
        out = []
        for b, core, *cols in zip(blk, own, *columns):
            cols = [np.asarray(c) for c in cols]
            n = len(cols[0])
            ends = np.array([group_end(i, n, *cols) for i in range(core)], dtype=np.int64)
            # at the end of what a full block sees, the next row could still belong
            unseen = (ends >= n) & (n == block_rows + look_ahead)
            out.append(np.where(unseen, -1, ends + b * block_rows + 1))
        return pd.Series(out)

    return blocks.select(*keys, "_blk", next_starts(F.col("_blk"), F.col("_own"), *[F.col(f"_rows.{c}").alias(c) for c in rules]).alias("_next"))


def _block_entries(blocks: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Per (key, block): the position it is entered at and the group that spills in."""

    @F.pandas_udf("array<bigint>")
    def landings(blk: pd.Series, nexts: pd.Series) -> pd.Series:
        out = []
        for b, nxt in zip(blk, nexts):
            nxt = np.unique(np.asarray(nxt, dtype=np.int64))
            out.append(nxt[nxt > b * block_rows + block_rows])
        return pd.Series(out)

    entries = (
        blocks.select(*keys, F.explode(landings("_blk", "_next")).alias("entry")).distinct()
        .withColumn("_blk", F.floor((F.col("entry") - 1) / block_rows).cast("bigint"))
        .unionByName(blocks.filter("_blk = 0").select(*keys, F.lit(1).cast("bigint").alias("entry"), "_blk"))
        .groupBy(*keys, "_blk").agg(F.collect_list("entry").alias("_entries"))
    )

    @F.pandas_udf("array<struct<entry:bigint,exit:bigint,last:bigint>>")
    def transitions(blk: pd.Series, nexts: pd.Series, entry_lists: pd.Series) -> pd.Series:
        out = []
        for b, nxt, entry_list in zip(blk, nexts, entry_lists):
            base = b * block_rows + 1
            found = []
            for e in entry_list:
                pos = last = int(e)
                while pos - base < len(nxt):
                    last, pos = pos, int(nxt[pos - base])
                found.append({"entry": int(e), "exit": pos, "last": last})
            out.append(found)
        return pd.Series(out)

    steps = (
        blocks.select(*keys, "_blk", "_next").join(entries, [*keys, "_blk"])
        .select(*keys, "_blk", F.explode(transitions("_blk", "_next", "_entries")).alias("t"))
        .select(*keys, "_blk", "t.entry", "t.exit", "t.last")
    )
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields if f.name in keys),
                        "_blk bigint", "entry bigint", "spill bigint"])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        table = {e: (x, l, b) for e, x, l, b in zip(part["entry"], part["exit"], part["last"], part["_blk"])}
        pos, spill, rows = 1, None, []
        while pos in table:
            end, last, b = table[pos]
            rows.append((b, pos, spill))
            # blocks that the group covers whole, and the one it ends in if no row follows it
            ended = (end - 1) // block_rows
            rows.extend((k, end, last) for k in range(b + 1, ended + (end not in table)))
            pos, spill = end, last
        result = pd.DataFrame(rows, columns=["_blk", "entry", "spill"])
        result["spill"] = result["spill"].astype("Int64")
        for offset, key in enumerate(keys):
            result.insert(offset, key, part[key].iloc[0])
        return result

    hot = blocks.filter("_blk > 0").select(*keys).distinct()
    return (steps.join(hot, keys, "left_semi").groupBy(*keys).applyInPandas(chain, schema)
            .select(*keys, "_blk", F.struct("entry", "spill").alias("_in")))
