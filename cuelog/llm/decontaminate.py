"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns

#: Normalised text: A-Z lower-cased, every other ASCII character but letters and digits a space.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def item_windows(items: Iterable[tuple[str, str | None]], width: int) -> dict[bytes, tuple[int, set[str]]]:
    """window (words joined by spaces) -> (its words, the ids of the items that have it)."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            part = words[i:i + width]
            found.setdefault(b" ".join(part), (len(part), set()))[1].add(item)
    return found


class Scanner:
    """The automaton, and what it finds in one text."""

    def __init__(self, windows: dict[bytes, tuple[int, set[str]]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for k, (window, (length, items)) in enumerate(windows.items()):
            # Bytes as Latin-1 characters: the automaton then works on one byte per character.
            self.automaton.add_word(f" {window.decode('latin-1')} ", (k, length, items))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str], list[tuple[int, int]]]:
        """(words, hit word positions, items, hit spans of the text in code points, end exclusive)."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), np.zeros(0, np.int64), set(), []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = [(end, length, items) for end, (_, length, items) in self.automaton.iter(line)]
        if not found:
            return len(words), np.zeros(0, np.int64), set(), []
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        change = np.zeros(len(words) + 1, np.int64)
        for end, length, _ in found:
            last = int(np.searchsorted(spaces, end))  # the space after the window's last word
            change[last - length] += 1
            change[last] -= 1
        covered = np.cumsum(change)[:-1] > 0
        return len(words), np.flatnonzero(covered), set().union(*(items for _, _, items in found)), self._spans(text, covered)

    @staticmethod
    def _spans(text: str, covered: np.ndarray) -> list[tuple[int, int]]:
        """Runs of covered words as spans of the original text."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.concatenate(([False], np.frombuffer(raw.tobytes().translate(_NORMAL), np.uint8) != 32, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        run = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        return [(int(chars[edge[2 * a]]), int(chars[edge[2 * b - 1]])) for a, b in zip(run[0::2], run[1::2], strict=True)]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, max_item_bytes: int = 64 << 20) -> DataFrame:
    """Add to every document what it shares with the test items.

    ``docs`` needs ``text``, ``items`` needs ``item_id`` and ``text``; result: the columns of
    ``docs`` and those of ``RESULT``.  Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased.  A window is ``width`` consecutive words of an item
    (all its words, if fewer); a document word inside an occurrence of any window is hit.
    ``items_sha256`` is over the sorted ids of the items found, comma-joined (none: of the
    empty string); ``hit_spans`` are code points of the original text.

    Null or empty texts have no words.  Items with a null id take part under the
    empty id.  Repeated items count once per id; repeated documents are judged each.

    The automaton is sent to every worker, so its size is checked: a benchmark beyond
    ``max_item_bytes`` is refused with an error; split it and join the verdicts.
    """
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_item_bytes:
        raise ValueError(f"the test items have {size} bytes, more than max_item_bytes={max_item_bytes}")
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").collect()
    sent = spark.sparkContext.broadcast(item_windows(rows, width))

    def make():
        scanner = Scanner(sent.value)

        def work(batch):
            out = [[], [], [], [], [], []]
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                n, hit, found, spans = scanner.scan(text)
                digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                for column, value in zip(out, (n, len(hit), len(found), digest, len(hit) > 0, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
            return out
        return work

    return append_columns(docs, make, RESULT)
