"""Correction files: blocks of source and translation to edit, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fmt_time
from ..functions.text import strip
from .writers import in_parts

# ---- fixed values: the block format ----
SOURCE_LINE = "ИСХОДНЫЙ:"
TARGET_LINE = "ПЕРЕВОД:"
END_LINE = "### END"
BLOCK = rf"(?ms)(^###\s+\d+\s+\|[^\n]*\n{SOURCE_LINE}\n.*?\n{TARGET_LINE}\n.*?^{END_LINE}\s*$)"
# ---- end of fixed values ----


def export_review(pairs: DataFrame, part_rows: int = 5000) -> DataFrame:
    """Correction documents per media, in parts: media_id, part, blocks, document."""
    number = F.when(F.col("seg_index") < 1000, F.lpad(F.col("seg_index").cast("string"), 3, "0")).otherwise(
        F.col("seg_index").cast("string"))
    block = F.concat_ws("\n", F.concat(F.lit("### "), number, F.lit(" | "), fmt_time("start"), F.lit(" -> "), fmt_time("end")),
                        F.lit(SOURCE_LINE), strip("source"), F.lit(TARGET_LINE), strip("translated"), F.lit(END_LINE), F.lit(""))
    lines = pairs.select("media_id", F.col("seg_index").cast("bigint").alias("seq"), block.alias("block"))
    return in_parts(lines, "block", "\n", part_rows, "blocks")


def import_review(documents: DataFrame) -> DataFrame:
    """Edited texts by block number: media_id, seg_index, edited.

    The last block of a number counts.  Numbers no segment has fall away when the edits are joined to the pairs.
    """
    text = F.regexp_replace("document", r"\r\n?", "\n")
    part = F.col("part") if "part" in documents.columns else F.lit(0)
    found = documents.select("media_id", part.alias("_part"), F.posexplode(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))).alias("_at", "b"))
    edited = F.regexp_extract("b", rf"(?ms)^{TARGET_LINE}\n(.*?)^{END_LINE}\s*$", 1)
    blocks = found.select("media_id", F.struct("_part", "_at").alias("_place"), F.regexp_extract("b", r"^###\s+(\d+)", 1).cast("bigint").alias("seg_index"),
                          strip(edited).alias("edited"))
    return blocks.groupBy("media_id", "seg_index").agg(F.max_by("edited", "_place").alias("edited"))
