"""Token counts: huge texts are encoded in overlapping chunks, spliced where both encodings have the same token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append_columns, cut_lineage, schema_of

#: Characters of a chunk beyond the overlap, and of the overlap at first; both grow by ``GROW`` where splicing fails.
CHUNK, OVERLAP, GROW = 32_768, 256, 4


class Coder:
    """A sentencepiece model that neither rewrites characters nor drops spaces: every token stands for characters of the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  ａ́\n x  "
        if self.model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError("the model rewrites texts; offsets of its tokens are not those of the text")
        width = []
        for k in range(self.model.vocab_size()):
            if self.model.is_byte(k):  # of a character in bytes, the first stands for it
                width.append(0 if 0x80 <= int(self.model.id_to_piece(k)[3:5], 16) < 0xC0 else 1)
            else:
                width.append(len(self.model.id_to_piece(k)))
        self.width = np.array(width, np.int64)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(place, number of tokens before) of every token that starts a character, then of the end; and the number of tokens.

        The model puts a space before the text, so the first token is at place -1.
        """
        ids = np.array(self.model.encode(text), np.int64)
        width = self.width[ids]
        first = np.flatnonzero(width > 0)
        place = np.concatenate(([0], np.cumsum(width[first]))) - 1
        if place[-1] != len(text):
            raise ValueError("tokens do not cover the text")
        return place, np.append(first, len(ids)), len(ids)


def _each(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows, one at a time: no second copy of a batch's texts."""
    for row in zip(*[batch.column(batch.schema.get_field_index(c)) for c in columns], strict=True):
        yield tuple(v.as_py() for v in row)


def _packed(place: np.ndarray, before: np.ndarray, low: int, high: int) -> bytes:
    """The token starts from ``low`` to ``high``, told from ``low``."""
    which = (place >= low) & (place <= high)
    return np.stack([place[which] - low, before[which]]).astype("<i8").tobytes()


def splice(left: bytes, right: bytes) -> tuple[int, int] | None:
    """Tokens of the left chunk up to and with the last common token, and of the right chunk up to and with it.

    Byte-pair merging gives a sequence of tokens exactly if it gives every pair of neighbours
    for the pair's own text.  Neighbours on the left of a common token are neighbours in the left encoding, those on its
    right in the right one, so the spliced sequence is the encoding of the whole text.
    """
    a, b = np.frombuffer(left, "<i8").reshape(2, -1), np.frombuffer(right, "<i8").reshape(2, -1)
    tokens = [np.unique(x[0][:-1] << 32 | x[0][1:], return_index=True) for x in (a, b)]
    common, i, j = np.intersect1d(tokens[0][0], tokens[1][0], assume_unique=True, return_indices=True)
    if not len(common):
        return None
    return int(a[1][tokens[0][1][i[-1]] + 1]), int(b[1][tokens[1][1][j[-1]] + 1])


def _round(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``key`` and ``n_tokens`` of every text (``key``, ``text``); null where a splice has failed."""
    pieces = schema_of("key long, chunk long, last boolean, piece string")
    edges = schema_of("key long, seam long, is_left boolean, tokens long, edge binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in _each(batch, "key", "text"):
                n = max(1, -(-len(text) // chunk))
                for k in range(n):
                    row = (key, k, k == n - 1, text[k * chunk:(k + 1) * chunk + overlap])
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, to_arrow_schema(pieces), strict=True)], names=pieces.names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(path)
            rows = []
            for key, k, last, piece in _each(batch, *pieces.names):
                place, before, n = coder.starts(piece)
                if k:
                    rows.append((key, k - 1, False, 0, _packed(place, before, 0, overlap)))
                if last:
                    rows.append((key, k, True, n, None))
                else:
                    rows.append((key, k, True, 0, _packed(place, before, chunk, chunk + overlap)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(edges), strict=True)], names=edges.names)

    dealt = texts.mapInArrow(cut, pieces).repartition("key", "chunk").mapInArrow(encode, edges)
    side = lambda left: F.max(F.when(F.col("is_left") == F.lit(left), F.col("edge")))
    seams = dealt.groupBy("key", "seam").agg(F.sum("tokens").alias("tokens"), side(True).alias("left"), side(False).alias("right"))

    def join():
        def work(batch):
            out = []
            for n, a, b in _each(batch, "tokens", "left", "right"):
                met = (n, 0) if a is None else splice(a, b)
                out.append(None if met is None else met[0] - met[1])
            return [out]
        return work

    known = append_columns(seams, join, "share long").groupBy("key").agg(F.sum("share").alias("n_tokens"), F.count("share").alias("_met"), F.count(F.lit(1)).alias("_seams"))
    return known.select("key", F.when(F.col("_met") == F.col("_seams"), F.col("n_tokens")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``, with the sentencepiece model at ``path``.

    Counts are those of the library for the whole text.  Texts of up to ``chunk`` characters are encoded at once.  Of a longer
    text, chunks of ``chunk`` characters and ``overlap`` more are rows of their own, dealt over the cluster; each gives
    the token starts in its overlaps, and two neighbours are spliced after the last token that both have at
    the same place, which is proof enough (``splice``).  Texts with two neighbours that have no common token are cut again with
    chunks and overlaps ``GROW`` times as long, at last as one chunk.

    A null text is empty: no bytes, no tokens.  Repeated rows and null ids are rows like others; an empty table has no
    rows; other columns are left out.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = (F.col("n_bytes") > chunk) & (F.char_length("text") > chunk)

    def whole():
        held: list[Coder] = []

        def work(batch):
            if not held:
                held.append(Coder(path))
            return [[held[0].count(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]]
        return work

    short = append_columns(sized.filter(~is_long), whole, "n_tokens long").drop("text")
    # Written once: the row numbers stay the same whatever is read of them later.
    huge = cut_lineage(sized.filter(is_long).withColumn("key", F.monotonically_increasing_id()))
    counted, left = None, huge.select("key", "text")
    while True:
        done = cut_lineage(_round(left, path, chunk, overlap))
        met = done.filter("n_tokens IS NOT NULL")
        counted = met if counted is None else counted.unionByName(met)
        failed = done.filter("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        chunk, overlap = chunk * GROW, overlap * GROW
        left = left.join(failed, "key", "left_semi")
    long = huge.drop("text").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
