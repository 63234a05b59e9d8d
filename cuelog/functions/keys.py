"""Hash keys: checkpoint segments, event signatures, cache entries, catalog items."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col, normalize_tts_text, strip


def segment_key(start, end, text) -> Column:
    """Key of a timed phrase; times print with three decimals."""
    times = [F.format_string("%.3f", _col(c).cast("double")) for c in (start, end)]
    return F.sha2(F.concat_ws("\n", *times, strip(text)), 256)


@F.pandas_udf(T.StringType())
def segment_key_exact(start: pd.Series, end: pd.Series, text: pd.Series) -> pd.Series:
    """The same key with Python's float printing, for checkpoints written elsewhere
    (the two differ only where a time ends in an exact half of a millisecond)."""
    return pd.Series([
        hashlib.sha256(f"{s:.3f}\n{e:.3f}\n{(t or '').strip()}".encode("utf-8", "replace")).hexdigest()
        for s, e, t in zip(start, end, text)])


def short_hash(*columns: Column, length: int = 20) -> Column:
    """Digest of a row of values; NULL and '' are the same value.

    Declared never NULL: a join on it then needs no NULL filter, which would
    compute the digest once more.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length), F.lit(""))


def cache_key(provider, language, voice, rate_pct, text, extra=None, schema: int = 1) -> Column:
    parts = F.struct(
        F.lit(schema).alias("schema"), _col(provider).alias("provider"), _col(language).alias("language"),
        _col(voice).alias("voice"), _col(rate_pct).cast("int").alias("rate_pct"),
        normalize_tts_text(text).alias("text"),
        (F.lit("") if extra is None else _col(extra)).alias("extra"))
    return F.sha2(F.to_json(parts), 256)


def catalog_fingerprint(*columns: str) -> Column:
    """Digest of the fields that define installed data; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
