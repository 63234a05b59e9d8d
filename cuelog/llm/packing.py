"""Best-fit packing of tokenised documents under several capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut_lineage, schema_of


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each dimension counts in the choice of a bin."""
    tokens: int = 4096
    documents: int | None = None   # None: as many as there are tokens
    attention: int | None = None   # sum of squared piece lengths; None: tokens squared
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"            # "norm": smallest weighted norm of what is left; "dot": largest weighted dot product

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], float)


class WordEncoder:
    """Token ids of texts, for a tokenizer file that lower-cases and never joins across white space.

    Words seen before are looked up; new ones go to the tokenizer together.  A text with a
    character outside printable ASCII and the Latin letters up to U+024F, or with ``<|`` (it
    may spell a special token), goes to the tokenizer as it is.
    """

    _UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įĲ-ɏ]|<\\|")
    _MOST = 400_000  # words held at once, about 100 MB
    _PLAIN = bytes([9, 10, 13, *range(32, 127)])

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as file:
            split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self._MOST:
            self.known.clear()
        split = {w: [w] if w.isalpha() else self.pieces(w) for w in words}
        fresh = list(dict.fromkeys(p for parts in split.values() for p in parts if p not in self.known))
        if fresh:
            coded = self.words.encode(" ".join(fresh), add_special_tokens=False)
            ids, cuts = np.array(coded.ids, "<u4"), np.searchsorted(coded.word_ids, np.arange(len(fresh) + 1))
            raw = ids.tobytes()
            for k, piece in enumerate(fresh):
                self.known[piece] = raw[4 * cuts[k]:4 * cuts[k + 1]]
        for word, parts in split.items():
            self.known[word] = b"".join([self.known[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._is_unusual(text):
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        missing = set(words).difference(self.known)
        if missing:
            self._learn(set(words) if len(self.known) + len(missing) > self._MOST else missing)
        return b"".join(map(self.known.__getitem__, words))

    def _is_unusual(self, text: str) -> bool:
        if text.isascii():
            return "<|" in text or bool(text.encode().translate(None, self._PLAIN))
        return self._UNUSUAL.search(text) is not None


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so its words serve all its tasks."""
    return WordEncoder(path)


#: Texts held as Python strings at once; a worker keeps the memory of its largest batch as long as it lives.
_ROWS = 256

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id`` and ``PIECE``: every document's ids and the end id, cut where longer than ``tokens``.

    A null text is empty and gives the end id alone.  Repeated rows give repeated pieces.
    ``tokenizer`` is the path of the file on the workers.
    """
    key = docs.select("doc_id").schema.fields
    schema = StructType([*key, *schema_of(PIECE).fields])
    arrow = to_arrow_schema(schema)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            rows, out = [], []
            for row, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                ids = encoder.encode(text or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at:at + 4 * tokens]
                    rows.append(row)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, pa.int64())),
                                              *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], names=arrow.names)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """Open bins, and vector best fit into them."""

    def __init__(self, capacity: Capacity):
        self.capacity, self.full = capacity, capacity.vector()
        self.left = np.zeros((3, 0))
        self.names: np.ndarray = np.zeros(0, np.int64)
        self.next = 0

    def _score(self, need: np.ndarray, left: np.ndarray) -> np.ndarray:
        weights = np.array(self.capacity.weights)
        if self.capacity.score == "dot":
            return -((weights * need / self.full ** 2) @ left)
        rest = (left - need[:, None]) / self.full[:, None]
        return weights @ (rest * rest)

    def put(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of every length; longer pieces choose first."""
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        room = len(self.names)
        left = np.concatenate([self.left, np.zeros((3, len(lengths)))], axis=1)
        names = np.concatenate([self.names, np.zeros(len(lengths), np.int64)])
        for k in np.argsort(-lengths, kind="stable"):
            n = float(lengths[k])
            need = np.array([n, 1.0, n * n])
            if (need > self.full).any():
                raise ValueError(f"a piece of {int(n)} tokens fits no empty sequence")
            fits = np.flatnonzero((left[0, :room] >= n) & (left[1, :room] >= 1) & (left[2, :room] >= n * n))
            if len(fits):
                at = int(fits[np.argmin(self._score(need, left[:, fits]))])
            else:
                at, room = room, room + 1
                left[:, at], names[at] = self.full, self.next
                self.next += 1
            bins[k], offsets[k] = names[at], int(self.full[0] - left[0, at])
            left[:, at] -= need
        self.left, self.names = left[:, :room], names[:room]
        return bins, offsets

    def close(self, most: int) -> None:
        """Forget full bins, and the fullest of more than ``most``."""
        keep = np.flatnonzero((self.left > 0).all(axis=0))
        keep = np.sort(keep[np.argsort(-self.left[0, keep], kind="stable")[:most]])
        self.left, self.names = self.left[:, keep], self.names[keep]


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), task_pieces: int = 50_000, chunk: int = 4096) -> DataFrame:
    """``pieces`` (with ``length``) and ``sequence_id``, ``offset``.

    Vector best fit, decreasing: tokens, documents and attention cost (the squared lengths)
    are capacities that all must hold; of the bins that can take a piece, the one with the
    smallest weighted norm of what stays free (or largest weighted dot product) gets it.

    Pieces are dealt evenly, about ``task_pieces`` to a task.  A task takes ``chunk`` pieces at a
    time, longest first, and carries up to ``chunk`` unfilled bins on to the next, so memory is bounded and
    only the bins open at a task's end stay unfilled.  The deal depends on the rows
    alone, so a repeated task packs the same.
    """
    pieces = pieces.drop("sequence_id", "offset")
    count = pieces.count()
    schema = StructType([*pieces.schema.fields, *schema_of("sequence_id long, offset long").fields])
    column = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bins = Bins(capacity)
        bins.next = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                names, offsets = bins.put(part.column(column).to_numpy(zero_copy_only=False).astype(np.int64))
                bins.close(chunk)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(offsets)], names=schema.names)

    return pieces.repartition(max(1, -(-count // task_pieces))).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity()) -> DataFrame:
    """Every piece of every document with its place: ``doc_id``, ``PIECE``, ``sequence_id``, ``offset``."""
    return pack(cut_lineage(cut_pieces(docs, tokenizer, capacity.tokens)), capacity)
