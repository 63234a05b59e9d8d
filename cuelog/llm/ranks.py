"""Places of rows in the order of their group, without a window over the rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ascending ``order``, nulls first, among rows of equal ``keys``) and ``n``, how many there are.

    Null keys are equal.  The rows are dealt by ranges of (keys, order, a number of the row), so a group of any size, and
    a run of any length of equal rows, spreads over the ranges; one row a range and group is then
    counted up.  ``rows`` is read twice (ranges are sampled): pass a written table.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(c) for c in [*keys, *order, "_row"]]
    dealt = cut_lineage(numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_row"))
    counts = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_part").alias("_p"), "_from",
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("n"))
    same = F.col("_part") == F.col("_p")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return dealt.join(places, same).select(*rows.columns, (F.col("_at") - F.col("_from") + F.col("_before")).alias("pos"), "n")
