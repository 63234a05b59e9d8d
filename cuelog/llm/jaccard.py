"""N-gram Jaccard join by vertical partitioning: fragments of the global order count partial overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Rolling, append_columns, cut_lineage, mix, schema_of, texts, words_of
from .components import components
from .repeats import unzip, zipped

#: Slots of the table of approximate counts, and how many travel in one row.
_SLOTS, _ROW = 1 << 20, 1 << 10
#: Bits of the map of documents whose sets are compared, and parities of a set.
_BITS, _PARITIES = 1 << 26, 2048


def shingles(text: np.ndarray, words: int = 4) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` words, A-Z lower-cased; of all words, if fewer."""
    hashes = words_of(text, lower=True)[2]
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    start = np.arange(len(hashes) - size + 1)
    return np.unique(Rolling(hashes).of(start, start + size))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
        yield from zip(keys.tolist(), texts(batch), strict=True)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """A row a document: ``key``, ``n`` and a 128-bit hash of its set; and rows of approximate counts by ``slot``."""
    schema = schema_of("key long, n long, a long, b long, slot int, counts binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(_SLOTS, np.int64), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

        for key, text in _rows(batches):
            found = shingles(text, words)
            np.add.at(table, (found & np.uint64(_SLOTS - 1)).astype(np.int64), 1)
            sums = [int(x) for x in np.stack([found, mix(found ^ np.uint64(0x2545F4914F6CDD1D))]).sum(axis=1, dtype=np.uint64).view(np.int64)]
            rows.append((key, len(found), *sums, None, None))
            if len(rows) >= 10_000:
                yield flush()
                rows = []
        for slot in np.flatnonzero(table.reshape(-1, _ROW).any(axis=1)):
            rows.append((None, None, None, None, int(slot), np.minimum(table[slot * _ROW:(slot + 1) * _ROW], (1 << 31) - 1).astype(np.int32).tobytes()))
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)


def _table(counted: DataFrame) -> np.ndarray:
    """The table of counts over all documents: sums of rows that stream by, 2**20 numbers in all."""
    schema = schema_of("slot int, counts binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[slot] = held.get(slot, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=schema.names)

    out = np.zeros(_SLOTS, np.int64)
    for row in counted.filter("slot IS NOT NULL").select("slot", "counts").repartition("slot").mapInArrow(add, schema).toLocalIterator():
        out[row.slot * _ROW:(row.slot + 1) * _ROW] += np.frombuffer(row.counts, np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def ceil_share(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m can be similar if their first common gram is at places i and j."""
    most = F.least(n - i, m - j)
    return ((100 + percent) * most >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _cuts(table: np.ndarray, fragments: int) -> list[tuple[int, int]]:
    """Where the global order (count, hash) is cut so that fragments hold about as many n-grams of the corpus each."""
    kinds, slots = np.unique(table[table > 0], return_counts=True)
    if not len(kinds):
        return []
    mass = np.cumsum(kinds.astype(np.float64) * slots)
    out = []
    for k in range(1, fragments):
        goal = mass[-1] * k / fragments
        at = int(np.searchsorted(mass, goal))
        before = mass[at - 1] if at else 0.0
        out.append((int(kinds[at]), int((goal - before) / (mass[at] - before) * ((1 << 64) - 1))))
    return out


def _fragment(found: np.ndarray, table: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The fragment of the global order that every n-gram belongs to."""
    counts = table[(found & np.uint64(_SLOTS - 1)).astype(np.int64)]
    out = np.zeros(len(found), np.int64)
    for count, edge in cuts:
        out += (counts > count) | ((counts == count) & (found >= np.uint64(edge)))
    return out


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` may be among ``keys``: all that are, and few others.

    A bitmap of fixed size (8 MB), whatever the number of keys; it spares texts the shuffle that the exact join behind it makes.
    """
    spark = docs.sparkSession
    slot = (F.pmod(F.xxhash64("key"), F.lit(_BITS)) + 1).alias("slot")
    maps = keys.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(_BITS // 8, np.uint8)
    for row in maps.toLocalIterator():
        table[(row.bucket - 1) * 4096:row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    held = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("slot")).to_numpy() - 1
            hit = (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    sought = docs.select("*", slot)
    return sought.mapInArrow(run, sought.schema).drop("slot")


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int, fragments: int, table) -> DataFrame:
    """The pairs (x, y) that are similar: partial overlaps of every fragment, summed for each pair.

    Before that, pairs that cannot be similar go: the bits in which the parities of two sets differ are at most the grams that
    only one of them has.  Grams are compared by 48 bits of their hashes.
    """
    ends = lambda pairs: pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    schema = schema_of("key long, n long, tag long, fragment int, segment binary")
    arrow, cuts = to_arrow_schema(schema), _cuts(table.value, fragments)

    def pieces(found: np.ndarray) -> Iterator[tuple[int, bytes]]:
        where = _fragment(found, table.value, cuts)
        for k in range(len(cuts) + 1):
            part = found[where == k]
            if len(part):
                yield k, part.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    def parities(found: np.ndarray) -> Iterator[tuple[int, bytes]]:
        odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % _PARITIES, minlength=_PARITIES) & 1
        yield 0, np.packbits(odd.astype(np.uint8)).tobytes()

    def cut(made):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
                for key, z in zip(keys, batch.column(batch.schema.get_field_index("z")).to_pylist(), strict=True):
                    found = shingles(unzip(z), words)
                    tag = int(found.sum(dtype=np.uint64).view(np.int64))
                    out += [(key, len(found), tag, *piece) for piece in made(found)]
                for a in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a:a + 5000], strict=True), arrow, strict=True)], names=arrow.names)
        return run

    # Rows of one id are one document; its sets have different tags, and those of equal rows are one.
    involved = cut_lineage(ends(pairs))
    held = cut_lineage(zipped(_only(docs, involved)).join(involved, "key").dropDuplicates(["key", "z"]))
    side = lambda key, rows: rows.select(F.col("key").alias(key), F.col("n").alias(f"n{key}"), F.col("tag").alias(f"tag{key}"), "fragment", F.col("segment").alias(f"s{key}"))
    bits = cut_lineage(held.mapInArrow(cut(parities), schema))

    def differ():
        count = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)

        def work(batch):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sx", "sy")]
            return [[int(count[np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)].sum()) for a, b in zip(*columns, strict=True)]]
        return work

    close = append_columns(pairs.join(side("x", bits).drop("fragment"), "x").join(side("y", bits).drop("fragment"), "y"), differ, "differ long")
    close = cut_lineage(close.filter((100 + percent) * F.col("differ") <= (100 - percent) * (F.col("nx") + F.col("ny"))).select("x", "y").distinct())

    left = ends(close)
    grams = cut_lineage(_only(held, left).join(left, "key").mapInArrow(cut(pieces), schema))

    def make():
        def values(raw: bytes) -> np.ndarray:
            out = np.zeros((len(raw) // 6, 8), np.uint8)
            out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            return out.view(np.uint64).ravel()

        def work(batch):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sx", "sy")]
            return [[len(np.intersect1d(values(a), values(b))) for a, b in zip(*columns, strict=True)]]
        return work

    met = close.join(side("x", grams), "x").join(side("y", grams), ["y", "fragment"]).select("x", "y", "nx", "ny", "tagx", "tagy", "sx", "sy")
    overlaps = append_columns(met, make, "common long").groupBy("x", "y", "nx", "ny", "tagx", "tagy").agg(F.sum("common").alias("common"))
    return overlaps.filter(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y").distinct()


def _shared(postings: DataFrame) -> DataFrame:
    """The postings whose ``gram`` others have too, equal ones once: one shuffle by gram, lists streamed in order, one row held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, and whether the row before it has its gram
        before = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            new = np.zeros(rows.num_rows - 1, bool)
            for column in rows.columns:
                new |= column.to_numpy()[1:] != column.to_numpy()[:-1]
            rows = rows.filter(pa.array(np.concatenate(([True], new))))
            gram = rows.column(rows.schema.get_field_index("gram")).to_numpy()
            same = gram[1:] == gram[:-1]
            keep = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
            held, before = rows.slice(rows.num_rows - 1), bool(same[-1]) if len(same) else before
        if held is not None and before:
            yield held

    return postings.repartition("gram").sortWithinPartitions("gram", "key", "n", "i").mapInArrow(run, postings.schema)


def _led(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of every list's lead, the set that has the gram earliest, and the others that can be similar to it."""
    schema = schema_of("x long, y long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, i, key, n = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("gram", "i", "key", "n"))
            fresh = np.concatenate(([lead is None or gram[0] != lead[0]], gram[1:] != gram[:-1]))
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(gram)), -1))
            of = lambda column, k: np.where(at >= 0, column[at], lead[k] if lead else 0)
            first, place, size = of(key, 2), of(i, 1), of(n, 3)
            most = np.minimum(n - i, size - place)
            keep = (key != first) & ((100 + percent) * most >= percent * (n + size)) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            found = np.unique(np.stack([np.minimum(key, first)[keep], np.maximum(key, first)[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=schema.names)
            lead = (gram[-1], place[-1], first[-1], size[-1])

    return listed.select("gram", "i", "key", "n").repartition("gram").sortWithinPartitions("gram", "i", "key", "n").mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, fragments: int = 4) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    A document's set: the distinct runs of ``words`` words (all words, if fewer), A-Z lower-cased; a null
    text or one without words has none and links with nothing.  Documents link when their
    sets share at least ``percent`` in a hundred of their union.  The component is the smallest ``doc_id``
    that links reach.  Rows with one id are one document, null ids too, which are larger than all others.

    1. Equal sets become one node, the smallest id; their hashes meet map-side.
    2. The global order of n-grams: by approximate counts over all documents (a table of
       bounded size; any table gives right results, rare-first makes short lists), then by hash.
    3. Similar sets share a gram among the first ``n - ceil(n * percent / 100) + 1`` of each.  Of every list
       of sets with such a gram, the set that has it earliest is compared with the others
       that can be similar by size and place.
    4. Compared sets are cut into ``fragments`` pieces of the global order, equal shares of the corpus each; overlaps are
       counted in each and summed for each pair.
    5. Lists that still hold several components give their other possible pairs between components,
       and these are compared too, so no link between components is lost; pairs inside one component are never made.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "text")
    counted = cut_lineage(_sets(base.select("key", "text"), words))
    sets = counted.filter("key IS NOT NULL").select("key", "n", "a", "b")
    nodes = cut_lineage(sets.filter("n > 0").groupBy("a", "b", "n").agg(F.min("key").alias("node")))
    table = spark.sparkContext.broadcast(_table(counted))
    schema = schema_of("key long, n int, grams array<long>")
    arrow = to_arrow_schema(schema)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for key, text in _rows(batches):
            found = shingles(text, words)
            if not len(found):
                continue
            size = len(found) - -(-len(found) * percent // 100) + 1
            order = np.lexsort((found, table.value[(found & np.uint64(_SLOTS - 1)).astype(np.int64)]))
            rows.append((key, len(found), found[order[:size]].view(np.int64)))
            held += size
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    postings = base.select("key", "text").mapInArrow(prefixes, schema).select("key", "n", F.posexplode("grams").alias("i", "gram"))
    # Of equal sets, and of rows with one id, the first node alone is looked at from here.
    listed = cut_lineage(_shared(postings).join(nodes.select(F.col("node").alias("key"), F.col("n").cast("int").alias("n")), ["key", "n"], "left_semi"))
    pairs = cut_lineage(_led(listed, percent).distinct())
    text = base.select("key", "text")
    links = cut_lineage(_verify(pairs, text, words, percent, fragments, table))
    grouped = cut_lineage(components(links))

    placed = listed.join(grouped.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).filter("_l < _h").select("gram")
    rest = cut_lineage(placed.join(mixed, "gram"))
    other = rest.select("gram", F.col("key").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("other"))
    across = rest.join(other, "gram").filter((F.col("key") < F.col("y")) & (F.col("component") != F.col("other")) & _possible(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    more = cut_lineage(across.select(F.col("key").alias("x"), "y").distinct().join(pairs, ["x", "y"], "left_anti"))
    found = cut_lineage(_verify(more, text, words, percent, fragments, table))
    copies = sets.join(nodes, ["a", "b", "n"]).select(F.col("key").alias("x"), F.col("node").alias("y")).filter("x <> y")
    joined = grouped.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(found).unionByName(copies)
    final = cut_lineage(components(joined))
    ended = sets.join(final, sets["key"] == final["node"], "left").withColumn("component_id", F.coalesce("component", "key"))
    real = lambda c: F.when(F.col(c) != F.lit((1 << 63) - 1), F.col(c))
    return ended.select(real("key").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))
