"""The few functions no built-in expresses: similarity ratio and nested JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import (AUTHORIZATION, CLIENT_TOKEN, CONNECTION_ID, COOKIE, CUT_MARK, HIDDEN, KEY_OR_TOKEN,
                   LABELLED_URL_QUERY, SECRET_KEY, URL_QUERY)

# ---- fixed values ----
TOO_DEEP = "<слишком глубокая структура>"
VOLATILE_KEYS = {
    "attempt", "elapsed_sec", "eta_sec", "first_timestamp", "last_timestamp", "next_probe_after_sec",
    "probe_number", "remaining_wait_sec", "sequence", "thread", "timestamp", "tts_segment_index",
    "segment_index",
}
# ---- end of fixed values ----


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity ratio of two texts."""
    return pd.Series([_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)])


def _ratio(a: str, b: str) -> float:
    """difflib's ratio; of equal texts, and where one begins the other, without the search.

    There the longest block is the whole shorter text: a block off the diagonal has an equally long
    one on it that difflib meets earlier, and what begins on the diagonal grows to both ends.
    """
    if a.startswith(b) or b.startswith(a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


#: What is hidden in a text: pattern and what takes its place, in this order.
SCRUBS = [(re.compile(URL_QUERY), r"\1?..."), (re.compile(LABELLED_URL_QUERY, re.I), r"\1?..."), (re.compile(CLIENT_TOKEN, re.I), r"\1..."),
          (re.compile(CONNECTION_ID, re.I), r"\1..."), (re.compile(AUTHORIZATION, re.I), rf"\1{HIDDEN}"),
          (re.compile(KEY_OR_TOKEN, re.I), rf"\1\2{HIDDEN}"), (re.compile(COOKIE, re.I), rf"\1\2{HIDDEN}")]
#: What varies between two reports of one problem.
MASKS = [(re.compile(r"(?:https?|wss?)://[^\s]+"), "<url>"), (re.compile(r"\b[0-9a-f]{16,}\b"), "<hash>"), (re.compile(r"\b\d+(?:\.\d+)?\b"), "<n>")]


def _replaced(text: str, table: list) -> str:
    return reduce(lambda out, rule: rule[0].sub(rule[1], out), table, text)


@dataclass(frozen=True)
class Reshape:
    """How a JSON value is copied: what becomes of texts, members, list items and depths."""
    text: Callable[[str], str]
    member: Callable[[str], str | None]  # "keep", "drop", or what stands for the value
    items: int
    counted: bool      # a shortened list says how long it was
    depth: int | None
    ordered: bool

    def copy(self, value):
        """The copy, built from a work list, so deep values need no deep call stack."""
        out: list = [None]
        work: list[tuple] = [(value, 0, out, 0)]
        while work:
            node, level, holder, place = work.pop()
            if self.depth is not None and level > self.depth:
                holder[place] = TOO_DEEP
            elif isinstance(node, str):
                holder[place] = self.text(node)
            elif isinstance(node, dict):
                holder[place] = made = {}
                for key in sorted(node) if self.ordered else node:
                    fate = self.member(key)
                    if fate == "keep":
                        made[key] = None
                        work.append((node[key], level + 1, made, key))
                    elif fate != "drop":
                        made[key] = fate
            elif isinstance(node, list):
                shown = [None] * min(len(node), self.items)
                short = self.counted and len(node) > self.items
                holder[place] = {"items": shown, "total_count": len(node), "shown_count": self.items, "truncated": True} if short else shown
                work.extend((node[k], level + 1, shown, k) for k in range(len(shown)))
            else:
                holder[place] = node
        return out[0]


def _without_secrets(text: str, most: int = 6000) -> str:
    clean = _replaced(text, SCRUBS)
    return clean if len(clean) <= most else clean[:most - 20].rstrip() + CUT_MARK


REDACTED = Reshape(_without_secrets, lambda key: HIDDEN if re.search(SECRET_KEY, key, re.I) else "keep", 200, True, 5, False)
SIGNATURE = Reshape(lambda text: _replaced(text.lower(), MASKS)[:500], lambda key: "drop" if key in VOLATILE_KEYS else "keep", 20, False, None, True)


def _each(texts: pd.Series, change) -> pd.Series:
    out = []
    for text in texts:
        try:
            out.append(json.dumps(change(json.loads(text)), ensure_ascii=False, separators=(",", ":")))
        except (TypeError, ValueError):
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def redact_details(texts: pd.Series) -> pd.Series:
    """Redacted copy of a JSON text: secret keys, text values, depth and list limits."""
    return _each(texts, REDACTED.copy)


@F.pandas_udf(T.StringType())
def signature_details(texts: pd.Series) -> pd.Series:
    """Stable form of a JSON text: volatile keys dropped, keys sorted, values normalised."""
    return _each(texts, SIGNATURE.copy)


_LAST_SPACE = re.compile(r"(?s).*\s")


@F.udtf(returnType=T.StructType().add("part_no", T.IntegerType()).add("part", T.StringType()))
class SplitText:
    """One row per part of a long text, for lateral joins."""

    def eval(self, text: str, limit: int = 3900) -> Iterator[tuple[int, str]]:
        rest, number = text or "", 0
        while rest:
            # the last white space of a full window, if it is in the window's second half
            space = _LAST_SPACE.match(rest[:limit]) if len(rest) > limit else None
            size = space.end() if space and space.end() >= limit // 2 else limit
            yield number, rest[:size]
            rest, number = rest[size:], number + 1


split_text_udtf = SplitText
