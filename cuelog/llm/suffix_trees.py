"""Removal of word passages that an earlier document has: suffix trees of prefix-partitioned suffixes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Rolling, append_columns, buffers, cut_lineage, mix, schema_of, words_of
from .repeats import (Lists, classes_of, contents, covered, find_runs, marks_by_document, release, repeated_runs, right_place, unzip, whole_groups, zipped)


def word_symbols(text: np.ndarray) -> np.ndarray:
    """One 64-bit symbol per word."""
    return words_of(text)[2]


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Of every row of word hashes, a hash of its first 1, 2, ... words."""
    out = np.empty_like(words)
    state = np.full(len(words), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for level in range(words.shape[1]):
        state = mix(state * np.uint64(0x9E3779B97F4A7C15) ^ words[:, level])
        out[:, level] = state
    return out


def deep_nodes(words: np.ndarray) -> np.ndarray:
    """The internal node of full depth above every suffix, by number; -1 where there is none.

    Suffixes in sorted order and the common prefixes of neighbours are the tree's leaves and
    the depths of the nodes between them: neighbours with a common prefix of full depth
    hang below one node.
    """
    n, depth = words.shape
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    common = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for level in range(depth):
        live = live[ordered[live, level] == ordered[live - 1, level]]
        common[live] = level + 1
    deep = common >= depth
    node = np.cumsum(~deep) - 1
    shared = deep | np.concatenate((deep[1:], [False]))[:n]
    out = np.full(n, -1, np.int64)
    out[order[shared]] = node[shared]
    return out


#: Instead of the first window of a mark: the window goes wherever its document has it.
_ANYWHERE = -1
SPAN = "key long, content binary"
SUFFIX = "part long, level int, key long, content binary"


def _suffixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, words, window hash) of every window of the spans in a batch."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index("content")))
    symbols = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), np.uint64)
    begin = (offsets[:-1] - offsets[0]) // 8
    n = (offsets[1:] - offsets[:-1]) // 8 - length + 1
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begin, n) + within
    key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
    return (np.repeat(key, n), np.lib.stride_tricks.sliding_window_view(symbols, length)[start], Rolling(symbols).of(start, start + length))


def _codes(words: np.ndarray, window: np.ndarray) -> pa.Array:
    """16 bits of every word and the window's 64-bit hash, high byte first: suffixes with equal codes have equal words."""
    rows = np.concatenate([(words >> np.uint64(48)).astype(np.uint16), np.ascontiguousarray(window).byteswap().view(np.uint16).reshape(-1, 4)], axis=1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (2 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def full_prefixes(spans: DataFrame, length: int, most: int, unseen: int = 64) -> DataFrame:
    """(level, prefix, n): prefixes of 1, 2, ... words that more than ``most`` suffixes have.

    Counted batch by batch, level by level; a prefix with up to ``unseen`` suffixes in a batch is
    not reported by it, so a group may grow beyond ``most`` by so many for each batch.
    """
    schema = schema_of("level int, prefix long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prefixes = prefix_hashes(_suffixes(batch, length)[1])
            for level in range(length):
                values, which, counts = np.unique(prefixes[:, level], return_inverse=True, return_counts=True)
                many = counts > unseen
                if not many.any():
                    break
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(many.sum()), level + 1, np.int32)), pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=schema.names)
                prefixes = prefixes[many[which]]

    return spans.mapInArrow(run, schema).groupBy("level", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > most)


def inside_windows(rolling: Rolling, size: int, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` words are in a window of ``length`` words whose hash is in ``windows``, at every place that has one."""
    change = np.zeros(size + 1, np.int32)
    if len(windows) and size >= length:
        start = np.arange(size - length + 1)
        at = start[np.isin(rolling.of(start, start + length).view(np.int64), windows)]
        change[at] += 1
        change[at + length] -= 1
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 13, gram: int = 4, group: int = 20_000, groups: int = 100_000) -> DataFrame:
    """What stays of every text when passages of earlier documents go.

    ``docs`` needs ``doc_id`` and ``text``.  Result, one row a row of ``docs``: ``doc_id``, ``n_words``,
    ``n_removed``, ``kept`` (binary: kept words joined by one space, UTF-8).  A word goes if it is in a
    window of ``length`` words whose words also start, in that order, in a document with a
    smaller ``doc_id``.  Words are runs without ASCII white space, as they are.  Null and empty texts
    have none.  Rows with one id do not take words from each other; null ids come after all others.

    1. Candidates: runs of windows with the same smallest gram (:mod:`.repeats`), whose name occurs again.
    2. Runs with the same words become one row with its first document; the other documents of
       such a row lose the run whole.
    3. The windows of runs with one name but different words are suffixes of ``length`` words.  They
       are partitioned by a prefix as long as it takes for at most ``group`` suffixes to share it (more
       where there are over ``groups`` times as many suffixes: the list of prefixes that are too
       full goes to all workers and is bounded by ``length * groups`` entries).
    4. Every part's suffix tree gives the windows that repeat, its deep internal nodes, and
       their first documents.  Such a window goes at every place of the later document, also where
       the document has the same run again, of which only the first was sent.  Suffixes that share all ``length`` words with too many are one repeat already;
       their first document is a minimum with map-side combine.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "text")
    runs = cut_lineage(repeated_runs(find_runs(base, word_symbols, length, gram), within=False))
    release(spark)
    classes = cut_lineage(classes_of(runs))
    names = classes.groupBy("name").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    multi = classes.join(names, "name").select("name", "span", "count", "classes", "rep.key", "rep.first", "rep.n")

    def cut(text: np.ndarray, key: int, found: dict):
        symbols = word_symbols(text)
        for k in right_place(Rolling(symbols), len(symbols), found, length):
            first = int(found["first"][k])
            yield key, symbols[first:first + int(found["n"][k]) + length - 1].tobytes()

    spans = cut_lineage(contents(multi, base, cut, SPAN))
    release(spark)
    total = multi.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full = spark.sparkContext.broadcast({(r.level, r.prefix) for r in full_prefixes(spans, length, max(group, total // groups)).collect()})
    release(spark)
    schema = to_arrow_schema(schema_of(SUFFIX))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        too_full = [np.array(sorted(p for level, p in full.value if level == k + 1), np.int64) for k in range(length)]
        for whole in batches:
            for batch in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                key, words, window = _suffixes(batch, length)
                prefixes = prefix_hashes(words).view(np.int64)
                level = np.zeros(len(key), np.int32)
                for k in range(length):
                    level[(level == k) & np.isin(prefixes[:, k], too_full[k])] = k + 1
                part = prefixes[np.arange(len(key)), np.minimum(level, length - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(level), pa.array(key.astype(np.int64)), _codes(words, window)], names=schema.names)

    suffixes = spans.mapInArrow(emit, schema_of(SUFFIX))
    solved = schema_of("key long, window long")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"], 4 << 20):
            data, offsets = buffers(table.column("content").combine_chunks())
            words = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), np.uint16).reshape(table.num_rows, -1)
            key = table.column("key").to_numpy()
            node = deep_nodes(words)
            below = np.flatnonzero(node >= 0)
            first = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, node[below], key[below])
            late = below[first[node[below]] < key[below]]
            window = np.ascontiguousarray(words[late, length:]).view(">i8").astype(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key[late]), pa.array(window)], names=solved.names)

    late = suffixes.filter(F.col("level") < length).repartition("part").sortWithinPartitions("part").mapInArrow(solve, solved)
    if any(level == length for level, _ in full.value):
        hash_of = F.conv(F.hex(F.substring("content", 2 * length + 1, 8)), 16, -10).cast("long")
        crowded = cut_lineage(suffixes.filter(F.col("level") == length).select("key", hash_of.alias("window")))
        first = crowded.groupBy("window").agg(F.min("key").alias("_first"))
        late = late.unionByName(crowded.join(first, "window").filter(F.col("_first") < F.col("key")).select("key", "window"))
    late = cut_lineage(late)
    release(spark)
    none = F.lit(None).cast("binary").alias("bits")
    whole = runs.join(classes.select("name", "span", F.col("rep.key").alias("_first")), ["name", "span"]).filter(F.col("_first") < F.col("key")).select("key", "first", "n", "span", none)
    marks = marks_by_document(whole.unionByName(late.select("key", F.lit(_ANYWHERE).alias("first"), F.lit(1).alias("n"), F.col("window").alias("span"), none)))

    def make():
        def work(batch):
            lists = Lists(batch.column(batch.schema.get_field_index("marks")))
            out = [[], [], []]
            for k, z in enumerate(batch.column(batch.schema.get_field_index("z")).to_pylist()):
                text, found = unzip(z), lists.row(k)
                words = text.tobytes().split()
                if len(found["first"]):
                    rolling, anywhere = Rolling(word_symbols(text)), found["first"] == _ANYWHERE
                    runs = {name: list(itertools.compress(values, ~anywhere)) if name == "bits" else values[~anywhere] for name, values in found.items()}
                    gone = covered(len(words), runs, right_place(rolling, len(words), runs, length), length)
                    gone |= inside_windows(rolling, len(words), found["span"][anywhere], length)
                    kept = list(itertools.compress(words, (~gone).tolist()))
                else:
                    kept = words
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    column.append(value)
            return out
        return work

    return append_columns(zipped(base).join(marks, "key", "left"), make, "n_words long, n_removed long, kept binary").drop("key", "z", "marks")
