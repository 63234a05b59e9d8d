"""Candidate search that the two substring operators share: windows grouped by their smallest gram.

Every window of ``length`` units (bytes or words) is named by the smallest hash among
its grams of ``gram`` units.  Equal windows have equal names, so repeats can only be
between windows of one name.  Consecutive windows of one name form a *run*; a run is sent
around as one row, not window by window.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Rolling, append_columns, schema_of, slide_min, texts

#: A run: its name, a hash of its whole span, first window, number of windows, and whether
#: the naming gram is at several places in it (only then can it have equal windows itself).
RUN = "name long, span long, first int, n int, again boolean"
#: Longest run, in windows; longer ones (periodic texts) are cut.
LONGEST = 4096
#: Windows of a text that are worked on at once.
_PIECE = 1 << 20


def runs_of(symbols: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The columns of ``RUN`` for one sequence of symbols, in pieces of bounded size."""
    pieces = [_runs(symbols[at:at + _PIECE + length - 1], length, gram, at) for at in range(0, max(1, len(symbols) - length + 1), _PIECE)]
    return tuple(np.concatenate(c) for c in zip(*pieces, strict=True)) if len(pieces) > 1 else pieces[0]


def _runs(symbols: np.ndarray, length: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    if len(symbols) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    rolling = Rolling(symbols)
    grams = rolling.grams(gram)
    # The place in the low bits makes the leftmost of equal grams the smallest, and tells where it is.
    low = np.uint64((1 << 21) - 1)
    place = (slide_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    least = grams[place]
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.concatenate((first, [len(least)])))
    again = place[first] != place[first + n - 1]
    if n.max() > LONGEST:
        times = -(-n // LONGEST)
        step = np.concatenate([np.arange(t) for t in times]) * LONGEST
        ends, again = np.repeat(first + n, times), np.repeat(again, times)
        first = np.repeat(first, times) + step
        n = np.minimum(ends - first, LONGEST)
    span = rolling.of(first, first + n + length - 1)
    return least[first].view(np.int64), span.view(np.int64), first + base, n, again


def repeated_runs(runs: DataFrame, within: bool) -> DataFrame:
    """The runs whose name occurs in more than one run, or (``within``) at several places of one.

    Counts are summed map-side, so a name with a third of all rows is one row for each
    task; the join back may be split by the optimizer.
    """
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("_count"), F.bool_or("again").alias("_again"))
    names = names.filter((F.col("_count") > 1) | F.col("_again") if within else F.col("_count") > 1).select("name")
    return runs.join(names, "name")


def classes_of(runs: DataFrame) -> DataFrame:
    """Runs with the same text as one row: ``name``, ``span``, ``count``, ``again`` and the first occurrence ``rep``."""
    return runs.groupBy("name", "span").agg(F.count(F.lit(1)).alias("count"), F.bool_or("again").alias("again"), F.min(F.struct("key", "first", "n")).alias("rep"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, whose plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def zipped(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed into ``z``, for the joins that move whole texts; null is empty."""
    def make():
        coder = zstandard.ZstdCompressor(level=3)

        def work(batch):
            return [[coder.compress(t) for t in texts(batch)]]
        return work

    return append_columns(docs, make, "z binary").drop("text")


def unzip(value: bytes) -> np.ndarray:
    """The bytes of a compressed text."""
    return np.frombuffer(zstandard.decompress(value), np.uint8)


def find_runs(docs: DataFrame, symbols: Callable[[np.ndarray], np.ndarray], length: int, gram: int) -> DataFrame:
    """All runs of all documents: ``key`` and the columns of ``RUN``, from ``key`` and ``text``."""
    schema = schema_of("key long, " + RUN)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            parts, held = [], 0
            for key, text in zip(keys, texts(batch), strict=True):
                found = runs_of(symbols(text), length, gram)
                parts.append((np.full(len(found[0]), key, np.int64), *found))
                held += len(found[0])
                if held > 100_000:
                    yield _batch(parts, arrow)
                    parts, held = [], 0
            if parts:
                yield _batch(parts, arrow)

    return docs.select("key", "text").mapInArrow(run, schema)


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)


class Lists:
    """The rows of a list-of-structs column, field by field."""

    def __init__(self, column: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        flat = column.flatten()
        self.fields = {f.name: (flat.field(k).to_pylist() if pa.types.is_binary(f.type) else flat.field(k).to_numpy(zero_copy_only=False)) for k, f in enumerate(flat.type)}

    def row(self, k: int) -> dict:
        return {name: values[self.starts[k]:self.ends[k]] for name, values in self.fields.items()}


def right_place(rolling: Rolling, size: int, marks: dict, length: int) -> np.ndarray:
    """Which marks (``first``, ``n``, ``span``) speak of this very text; rows may share a key."""
    first, end = marks["first"].astype(np.int64), marks["first"].astype(np.int64) + marks["n"] + length - 1
    inside = end <= size
    same = np.zeros(len(first), bool)
    same[inside] = rolling.of(first[inside], end[inside]).view(np.int64) == marks["span"][inside]
    return np.flatnonzero(same)


def covered(size: int, marks: dict, which: np.ndarray, length: int) -> np.ndarray:
    """Units inside a marked window; a mark without ``bits`` stands for all windows of its run."""
    change = np.zeros(size + 1, np.int32)
    for k in which:
        first, n, bits = int(marks["first"][k]), int(marks["n"][k]), marks["bits"][k]
        if bits is None:
            change[first] += 1
            change[first + n + length - 1] -= 1
        else:
            at = first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
    return np.cumsum(change)[:-1] > 0


def contents(multi: DataFrame, docs: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """What ``cut`` makes of every representative run, from the text that has it.

    ``multi`` has ``name``, ``span``, ``count``, ``classes``, ``key``, ``first`` and ``n``; ``cut(text bytes, runs)``
    yields tuples of columns for ``schema``.
    """
    arrow = to_arrow_schema(schema_of(schema))
    wanted = multi.groupBy("key").agg(F.collect_list(F.struct("name", "span", "count", "classes", "first", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(batch.column(batch.schema.get_field_index("runs")))
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            rows, held = [], 0
            for k, z in enumerate(batch.column(batch.schema.get_field_index("z")).to_pylist()):
                for row in cut(unzip(z), int(keys[k]), lists.row(k)):
                    rows.append(row)
                    held += 1
                if held > 20_000:
                    yield _rows(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, arrow)

    return zipped(docs.select("key", "text")).join(wanted, "key").mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``group``: a table ends with a group once it has ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        edge = np.zeros(table.num_rows - 1, bool)
        for name in group:
            values = table.column(name).to_numpy()
            edge |= values[1:] != values[:-1]
        cuts = np.flatnonzero(edge)
        if len(cuts):
            yield table.slice(0, int(cuts[-1]) + 1)
            held = table.slice(int(cuts[-1]) + 1).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def marks_by_document(marks: DataFrame) -> DataFrame:
    """One row a key with its distinct marks: bounded by the length of the document."""
    return marks.groupBy("key").agg(F.collect_set(F.struct("first", "n", "span", "bits")).alias("marks"))
