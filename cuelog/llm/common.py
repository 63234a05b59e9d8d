"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import cut_lineage  # noqa: F401  (imported from here by the operators)

#: Words are runs of anything but these six ASCII characters.
SPACE = "\\x20\\x09-\\x0D"

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of any substring of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _power(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of symbols start..end (end exclusive)."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw ^ (np.asarray(end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:len(self.sums) - k])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """One 64-bit symbol per byte."""
    return _TABLE[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


#: Word separators; with ``lower`` the table also turns A-Z into a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BLOCK = 1 << 20


def words_of(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of one text's bytes.

    Works through blocks of about a megabyte, cut where a word ends, so the memory for
    prefix sums does not grow with the text.
    """
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        while stop < len(data) and not IS_SPACE[data[stop]]:
            more = np.flatnonzero(IS_SPACE[data[stop:stop + _BLOCK]])
            stop = stop + int(more[0]) if len(more) else min(len(data), stop + _BLOCK)
        part = data[at:stop]
        inside = np.concatenate(([False], ~IS_SPACE[part], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[0::2], edge[1::2]
        rolling = Rolling(byte_symbols(LOWER[part] if lower else part))
        starts.append(first + at)
        ends.append(last + at)
        hashes.append(rolling.of(first, last))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """The bytes of every row's text, without copies."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[begin:end]


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def schema_of(text: str) -> StructType:
    """A schema from its DDL string."""
    return _parse_datatype_string(text)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[list]]], ddl: str) -> DataFrame:
    """``df`` and new columns, made batch by batch in Python.

    ``make`` runs once a task and returns the function from an Arrow batch to the new
    columns' values.  The other columns pass through as they are, nulls included; columns of
    ``df`` that have a new column's name give way to it.
    """
    new = schema_of(ddl)
    df = df.drop(*new.names)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            values = work(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, f.type) for v, f in zip(values, arrow, strict=True))],
                names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, as lambdas would compute it for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
