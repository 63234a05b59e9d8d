"""Exact removal of repeated byte strings: two-stage suffix sorting over grouped candidates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Rolling, append_columns, byte_symbols, cut_lineage, schema_of
from .repeats import (Lists, classes_of, contents, covered, find_runs, marks_by_document, release, repeated_runs, right_place, unzip, whole_groups, zipped)


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from every position on as one number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    n = len(data) + depth + 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k:k + n] << np.uint64(56 - 8 * k)
    return out


def ascending(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    if not len(data):
        return np.zeros(0, bool)
    change = np.flatnonzero(data[:-1] != data[1:])
    at = np.searchsorted(change, np.arange(len(data)))
    known = at < len(change)
    out = np.zeros(len(data), bool)
    where = change[at[known]]
    out[known] = data[where] < data[where + 1]
    return out


def _direct(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by ``depth`` bytes, eight at a time, only ties going on to the next eight."""
    pos = pos[np.argsort(words[pos], kind="stable")]
    if len(pos) < 2:
        return pos
    new = np.concatenate(([True], words[pos[1:]] != words[pos[:-1]]))
    for step in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(tied):
            break
        group, key = np.cumsum(new)[tied], words[pos[tied] + step]
        apart = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1]))
        if not len(apart):
            continue
        mixed = np.zeros(int(group[-1]) + 1, bool)  # only groups whose keys differ need sorting
        mixed[group[apart]] = True
        some = mixed[group]
        tied, group, key = tied[some], group[some], key[some]
        order = np.lexsort((key, group))
        pos[tied] = pos[tied][order]
        key = key[order]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return pos


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``data`` in the order of their first ``depth`` bytes or more.

    Only suffixes smaller than their successors are sorted directly.  Each of the others
    follows from its successor: buckets by first byte are scanned in ascending order, and
    the predecessor of every scanned suffix, if it is of the other kind, goes to the front part of
    its own bucket.  A bucket's induced part is scanned in waves, as it grows while it is
    scanned; the directly sorted part of a bucket comes after it.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    up = ascending(data)
    direct = _direct(_words(data, depth), np.flatnonzero(up), depth)
    edges = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    queue: dict[int, list[np.ndarray]] = defaultdict(list)
    queue[int(data[-1])].append(np.array([len(data) - 1]))  # the last suffix follows from the empty one

    def scan(wave: np.ndarray, byte: int) -> np.ndarray:
        """Deal out the predecessors of a wave; those of the same bucket are the next wave."""
        before = wave[wave > 0] - 1
        before = before[~up[before]]
        first = data[before]
        higher = before[first != byte]
        if len(higher):
            order = np.argsort(data[higher], kind="stable")
            higher = higher[order]
            cuts = np.flatnonzero(np.diff(data[higher].astype(np.int16))) + 1
            for part in np.split(higher, cuts):
                queue[int(data[part[0]])].append(part)
        return before[first == byte]

    out = []
    for byte in range(256):
        waves = queue.pop(byte, [])
        wave = np.concatenate(waves) if waves else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, byte)
        sorted_part = direct[edges[byte]:edges[byte + 1]]
        if len(sorted_part):
            out.append(sorted_part)
            scan(sorted_part, byte)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of every suffix in the order with the one before it, up to ``most`` bytes (a multiple of 8 is found exactly, else rounded down to one)."""
    words = _words(data, most)
    lengths = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for step in range(0, most - 7, 8):
        live = live[words[order[live] + step] == words[order[live - 1] + step]]
        if not len(live):
            break
        lengths[live] += 8
    return lengths


SPAN = "name long, span long, salt int, salted boolean, key long, first int, n int, weight int, content binary"


def _repeated_windows(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first window's class, class of every window, number of starts of every window) by suffix order."""
    content = table.column("content").to_pylist()
    size = np.array([len(c) for c in content])
    data = np.frombuffer(b"".join(content), np.uint8)
    begin = np.cumsum(size) - size
    windows = size - length + 1
    valid = np.zeros(len(data), bool)
    owner = np.repeat(np.arange(len(size)), size)
    valid[np.concatenate([np.arange(b, b + w) for b, w in zip(begin, windows, strict=True)])] = True
    order = two_stage_order(data, length)
    order = order[valid[order]]
    same = common_prefixes(data, order, length) >= length
    group = np.cumsum(~same) - 1
    weight = table.column("weight").to_numpy()
    total = np.bincount(group, weight[owner[order]])
    counts, classes = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    counts[order], classes[order] = total[group], group
    for row, (b, w) in enumerate(zip(begin, windows, strict=True)):
        yield row, classes[b:b + w], counts[b:b + w]


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 48, group: int = 4096) -> DataFrame:
    """What stays of every text when bytes in repeated ``length``-byte strings go.

    ``docs`` needs ``doc_id`` and ``text``.  Result, one row a row of ``docs``: ``doc_id``, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept`` (binary).  A byte goes if a ``length``-byte string over it
    starts at two or more places of all texts, the same text and overlaps included;
    strings do not cross texts.  ``length`` is a multiple of 8.  Null and empty texts have no bytes.
    Repeated rows are copies of each other, whatever their ids; a null id is a value like any other.

    1. Candidates: runs of windows with the same smallest gram (:mod:`.repeats`), whose name occurs again.
    2. Runs with the same whole text become one row with a weight, so copies cost nothing further.
    3. Runs of one name but different text meet in one task, at most ``group`` at a time; there a
       two-stage suffix sort and adjacent common prefixes find the repeated strings.
    4. Names with more runs are dealt over several such groups, which then exchange one row
       for each string still without a partner.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "text")
    runs = cut_lineage(repeated_runs(find_runs(base, byte_symbols, length, gram), within=True))
    release(docs.sparkSession)
    classes = cut_lineage(classes_of(runs))
    names = classes.groupBy("name").agg(F.count(F.lit(1)).alias("classes"), F.bool_or(F.col("again") & (F.col("count") == 1)).alias("_again"))
    names = names.filter("classes > 1 OR _again").drop("_again")
    multi = classes.join(names, "name").select("name", "span", "count", "classes", "rep.key", "rep.first", "rep.n")

    def cut(text: np.ndarray, key: int, found: dict):
        rolling = Rolling(byte_symbols(text))
        for k in right_place(rolling, len(text), found, length):
            first, n, classes = int(found["first"][k]), int(found["n"][k]), int(found["classes"][k])
            salts = -(-classes // group)
            yield (int(found["name"][k]), int(found["span"][k]), int(found["span"][k]) % salts, salts > 1, key, first, n, min(2, int(found["count"][k])), text[first:first + n + length - 1].tobytes())

    spans = cut_lineage(contents(multi, base, cut, SPAN))
    release(docs.sparkSession)
    solved = "key long, first int, n int, span long, bits binary, name long, window long, weight int, place int"
    arrow = to_arrow_schema(schema_of(solved))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["name", "salt"], 2 << 20):
            # rows that share an id give the same span more than once
            names, hashes = (table.column(c).to_numpy() for c in ("name", "span"))
            table = table.take(np.sort(np.unique(np.stack([names, hashes]), axis=1, return_index=True)[1]))
            rows = []
            columns = {c: table.column(c).to_pylist() for c in ("name", "span", "salted", "key", "first", "n", "weight", "content")}
            told: set[int] = set()
            for row, window_classes, counts in _repeated_windows(table, length):
                own = {c: values[row] for c, values in columns.items()}
                twice = counts >= 2
                if own["weight"] < 2 and twice.any():
                    rows.append((own["key"], own["first"], own["n"], own["span"], np.packbits(twice).tobytes(), None, None, None, None))
                if own["salted"]:
                    places = np.arange(own["n"])
                    hashes = Rolling(byte_symbols(np.frombuffer(own["content"], np.uint8))).of(places, places + length).view(np.int64)
                    for place, (which, times) in enumerate(zip(window_classes.tolist(), counts.tolist(), strict=True)):
                        if times < 2:
                            rows.append((own["key"], own["first"], own["n"], own["span"], None, own["name"], int(hashes[place]), 1, place))
                        elif which not in told:
                            told.add(which)
                            rows.append((None, None, None, None, None, own["name"], int(hashes[place]), 2, None))
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 50_000], strict=True), arrow, strict=True)], names=arrow.names)

    grouped = spans.repartition("name", "salt").sortWithinPartitions("name", "salt")
    answers = cut_lineage(grouped.mapInArrow(solve, schema_of(solved)))
    release(docs.sparkSession)
    full = runs.join(classes.filter("count > 1").select("name", "span"), ["name", "span"]).select("key", "first", "n", "span", F.lit(None).cast("binary").alias("bits"))
    partial = answers.filter("bits IS NOT NULL").select("key", "first", "n", "span", "bits")
    waiting = answers.filter("window IS NOT NULL")
    twice = waiting.groupBy("name", "window").agg(F.sum("weight").alias("_total")).filter("_total > 1").select("name", "window")
    late = waiting.filter("place IS NOT NULL").join(twice, ["name", "window"]).select(
        "key", (F.col("first") + F.col("place")).alias("first"), F.lit(1).alias("n"), F.col("window").alias("span"), F.lit(None).cast("binary").alias("bits"))
    marks = marks_by_document(full.unionByName(partial).unionByName(late))

    def make():
        def work(batch):
            lists = Lists(batch.column(batch.schema.get_field_index("marks")))
            out = [[], [], [], []]
            for k, z in enumerate(batch.column(batch.schema.get_field_index("z")).to_pylist()):
                text, found = unzip(z), lists.row(k)
                gone = np.zeros(len(text), bool)
                if len(found["first"]):
                    gone = covered(len(text), found, right_place(Rolling(byte_symbols(text)), len(text), found, length), length)
                edges = np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1)
                for column, value in zip(out, (len(text), int(gone.sum()), int(edges), text[~gone].tobytes()), strict=True):
                    column.append(value)
            return out
        return work

    joined = zipped(base).join(marks, "key", "left")
    return append_columns(joined, make, "n_bytes long, n_removed long, n_spans long, kept binary").drop("key", "z", "marks")
