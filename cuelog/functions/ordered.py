"""Ordered computations per key that stay parallel when one key is huge.

A Spark window sorts a whole partition key in one task.  Here a key is cut into
consecutive blocks of its order axis: windows run per (key, block), each block
is summed up in one row, the block rows are scanned per key, and the result is
joined back as the block's starting state.  Only block rows of a key ever meet
in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


@dataclass(frozen=True)
class Scan:
    kind: str
    expr: Column | None = None
    default: Column | None = None


def row_number() -> Scan:
    return Scan("row_number")


def running_sum(expr: Column) -> Scan:
    """Sum of this and all earlier rows."""
    return Scan("sum", expr)


def sum_before(expr: Column) -> Scan:
    """Sum of all earlier rows, 0 on the first."""
    return Scan("sum_before", expr)


def running_max(expr: Column) -> Scan:
    return Scan("max", expr)


def max_before(expr: Column) -> Scan:
    """Maximum of all earlier rows, NULL on the first."""
    return Scan("max_before", expr)


def previous(expr: Column, default: Column | None = None) -> Scan:
    """Value on the row before, like ``lag``."""
    return Scan("previous", expr, default)


def following(expr: Column, default: Column | None = None) -> Scan:
    """Value on the row after, like ``lead``."""
    return Scan("following", expr, default)


def last_known(expr: Column) -> Scan:
    """Latest non-NULL value up to and including this row."""
    return Scan("last_known", expr)


def known_before(expr: Column) -> Scan:
    """Latest non-NULL value on an earlier row."""
    return Scan("known_before", expr)


def next_known(expr: Column) -> Scan:
    """Earliest non-NULL value on a later row."""
    return Scan("next_known", expr)


def every(column: str, width: float) -> Column:
    """Block number for a numeric order axis cut every ``width``."""
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], block: Column | str,
                 **scans: Scan) -> DataFrame:
    """Add one column per scan, computed over ``keys`` in ascending ``order``.

    ``block`` must not decrease along ``order``; ``keys`` must not be NULL.  Given
    as a column name it stays in the result, and a second scan over the same
    column needs no new shuffle of the rows.
    """
    name = block if isinstance(block, str) else BLOCK
    rows = df if isinstance(block, str) else df.withColumn(BLOCK, block)
    return _scan(rows, keys, order, name, df.columns, scans)


def _scan(rows: DataFrame, keys: list[str], order: list[str], block: str, keep: list[str],
          scans: dict[str, Scan]) -> DataFrame:
    within = Window.partitionBy(*keys, block).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    after = within.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*[F.col(c) for c in order])

    per_row: dict[str, Column] = {}
    per_block: list[Column] = []
    over_blocks: dict[str, Column] = {}
    final: dict[str, Column] = {}
    blocks = Window.partitionBy(*keys).orderBy(block)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)

    for name, scan in scans.items():
        here, total, carry = f"_l_{name}", f"_b_{name}", f"_c_{name}"
        e = scan.expr
        if scan.kind == "row_number":
            per_row[here] = F.row_number().over(within).cast("bigint")
            per_block.append(F.count(F.lit(1)).alias(total))
            over_blocks[carry] = F.sum(total).over(earlier)
            final[name] = F.col(here) + F.coalesce(F.col(carry), F.lit(0))
        elif scan.kind in ("sum", "sum_before"):
            frame = upto if scan.kind == "sum" else before
            per_row[here] = F.sum(e).over(frame)
            per_block.append(F.sum(e).alias(total))
            over_blocks[carry] = F.sum(total).over(earlier)
            final[name] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
        elif scan.kind in ("max", "max_before"):
            frame = upto if scan.kind == "max" else before
            per_row[here] = F.max(e).over(frame)
            per_block.append(F.max(e).alias(total))
            over_blocks[carry] = F.max(total).over(earlier)
            final[name] = F.greatest(F.col(here), F.col(carry))
        elif scan.kind in ("previous", "following"):
            step = F.lag if scan.kind == "previous" else F.lead
            edge = F.max_by if scan.kind == "previous" else F.min_by
            boxed = F.struct(e.alias("v"))
            per_row[here] = step(boxed).over(within)
            per_block.append(edge(boxed, place).alias(total))
            over_blocks[carry] = step(total).over(blocks)
            value = F.coalesce(F.col(here), F.col(carry))
            final[name] = value["v"] if scan.default is None else (
                F.when(value.isNull(), scan.default).otherwise(value["v"]))
        elif scan.kind == "last_known":
            per_row[here] = F.last(e, ignorenulls=True).over(upto)
            per_block.append(F.max_by(e, F.when(e.isNotNull(), place)).alias(total))
            over_blocks[carry] = F.last(total, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(here), F.col(carry))
        elif scan.kind == "known_before":
            per_row[here] = F.last(e, ignorenulls=True).over(before)
            per_block.append(F.max_by(e, F.when(e.isNotNull(), place)).alias(total))
            over_blocks[carry] = F.last(total, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(here), F.col(carry))
        elif scan.kind == "next_known":
            per_row[here] = F.first(e, ignorenulls=True).over(after)
            per_block.append(F.min_by(e, F.when(e.isNotNull(), place)).alias(total))
            over_blocks[carry] = F.first(total, ignorenulls=True).over(later)
            final[name] = F.coalesce(F.col(here), F.col(carry))
        else:
            raise ValueError(scan.kind)

    carried = (rows.groupBy(*keys, block).agg(*per_block)
               .select(*keys, block, *[c.alias(n) for n, c in over_blocks.items()]))
    local = rows.select("*", *[c.alias(n) for n, c in per_row.items()])
    joined = local.join(carried, [*keys, block], "left")
    return joined.select(*[F.col(c) for c in keep if c not in final], *[c.alias(n) for n, c in final.items()])
