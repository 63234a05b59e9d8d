"""Text scalars: cleaning, redaction, signatures, tokens and script counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, word lists and placeholders whose results must match ----
HIDDEN = "<скрыто>"
CUT_MARK = "\n...<обрезано>"
SPACE = r"[\s\x1c-\x1f]"
URL_QUERY = r"((?:https?|wss?)://[^\s'\"<>?)]+)\?[^\s'\"<>)]*"
LABELLED_URL_QUERY = r"(url:\s+[^\s?]+)\?[^\s)]*"
CLIENT_TOKEN = r"(TrustedClientToken=)[^&\s)]+"
CONNECTION_ID = r"(ConnectionId=)[^&\s)]+"
AUTHORIZATION = r"(authorization\s*[:=]\s*)(?:(?:bearer|basic)\s+)?[^\s,;]+"
KEY_OR_TOKEN = r"(api[_-]?key|access[_-]?token|refresh[_-]?token)(\s*[:=]\s*)([^\s,;]+)"
COOKIE = r"(cookie|set-cookie)(\s*[:=]\s*)[^\r\n]+"
SECRET_KEY = r"(password|secret|token|api.?key|authorization)"
NUMERIC_TOKEN = "\\d+(?:(?:[.,:/-]\\d+)|(?:[ \u00A0]\\d{3}))*"
PROTECTED_URL = r"https?://[^\s<>]+|www\.[^\s<>]+"
PROTECTED_TOKEN = rf"(?:{PROTECTED_URL}|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}})"
WORD = r"[\p{L}\p{N}_]"
LATIN = r"A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
CYRILLIC = r"А-Яа-яЁё"
SCRIPT_RANGES = {
    "ar": "[\u0600-\u06FF]",
    "fa": "[\u0600-\u06FF]",
    "he": "[\u0590-\u05FF]",
    "el": "[\u0370-\u03FF]",
    "zh": "[\u3400-\u4DBF\u4E00-\u9FFF]",
    "ja": "[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]",
    "ko": "[\uAC00-\uD7AF\u1100-\u11FF]",
}
# ---- end of fixed values ----


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(body, **values: Column) -> Column:
    """``body(v)`` with the values computed once.

    An expression used inside a lambda is evaluated for every element; held in
    the one element of an outer array it is evaluated once per row.
    """
    held = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return F.get(F.transform(held, lambda v: body(v)), F.lit(0))


def strip(text) -> Column:
    """Trim every kind of white space, not only blanks; NULL becomes ''."""
    text = F.coalesce(_col(text), F.lit(""))
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))  # most texts have nothing to trim
    return F.when(edges.rlike(rf"(?U){SPACE}"), F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def rstrip(text) -> Column:
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?U){SPACE}+$", "")


def lstrip(text) -> Column:
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?U)^{SPACE}+", "")


def collapse(text) -> Column:
    """One blank for every run of white space, none at the ends."""
    return strip(F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"(?U){SPACE}+", " "))


def normalize_tts_text(text) -> Column:
    """Light clean-up before synthesis: blanks, dashes, doubled punctuation."""
    out = collapse(text)
    out = F.regexp_replace(out, "[—–]", ", ")
    out = F.regexp_replace(out, rf"(?U){SPACE}+([,.!?;:])", "$1")
    out = F.regexp_replace(out, r"([,.!?;:]){3,}", "$1")
    return strip(out)


def safe_log_filename(value, max_len: int = 80) -> Column:
    out = F.regexp_replace(F.coalesce(_col(value), F.lit("")), rf"[^0-9A-Za-z{CYRILLIC}._-]+", "_")
    out = F.btrim(out, F.lit("._-"))
    out = F.btrim(F.substring(out, 1, max_len), F.lit("._-"))
    return F.when(out == "", F.lit("session")).otherwise(out)


def safe_code(value, fallback: str = "auto") -> Column:
    out = F.regexp_replace(F.coalesce(_col(value), F.lit("")), r"(?U)[^\p{L}\p{N}_-]", "_")
    out = F.btrim(out, F.lit("_-"))
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def _mask(text: Column) -> Column:
    """Each pattern runs only on texts with parts that all its matches have; i, k and s stay out of the parts, as other letters match them too."""
    has = lambda v, part: F.contains(v["low"], F.lit(part))
    rules = [(lambda v: has(v, "://") & has(v, "?"), rf"(?U){URL_QUERY}", "$1?..."),
             (lambda v: has(v, "url:") & has(v, "?"), rf"(?iU){LABELLED_URL_QUERY}", "$1?..."),
             (lambda v: has(v, "entto"), rf"(?iU){CLIENT_TOKEN}", "$1..."),
             (lambda v: has(v, "onnect"), rf"(?iU){CONNECTION_ID}", "$1..."),
             (lambda v: has(v, "author"), rf"(?iU){AUTHORIZATION}", "$1" + HIDDEN),
             (lambda v: (has(v, "ap") & has(v, "ey")) | has(v, "acce") | has(v, "refre"), rf"(?iU){KEY_OR_TOKEN}", "$1$2" + HIDDEN),
             (lambda v: has(v, "coo"), rf"(?iU){COOKIE}", "$1$2" + HIDDEN)]

    def masked(v: Column, out: Column, left: list) -> Column:
        if not left:
            return out
        where, pattern, into = left[0]
        return let(lambda u: masked(v, F.when(where(v), F.regexp_replace(u["t"], pattern, into)).otherwise(u["t"]), left[1:]), t=out)

    return let(lambda v: masked(v, v["text"], rules), text=text, low=F.lower(text))


def _cut(text: Column, length: int, keep: int, mark: str) -> Column:
    """Texts over ``length`` become their first ``keep`` characters, without white space at the end, and ``mark``."""
    short = lambda v: F.regexp_replace(F.substring(v["t"], 1, keep), rf"(?U){SPACE}+$", "")
    return let(lambda v: F.when(F.length(v["t"]) <= length, v["t"]).otherwise(F.concat(short(v), F.lit(mark))), t=text)


def redact(text, max_len: int = 30000) -> Column:
    """Hide URL queries, tokens, keys and cookies; keep line breaks."""
    return _cut(_mask(F.coalesce(_col(text).cast("string"), F.lit(""))), max_len, max_len - 20, CUT_MARK)


def compact_error(text, max_len: int = 360) -> Column:
    """Redacted error text on one line."""
    # held, as strip looks at its text several times
    flat = F.regexp_replace(_mask(F.coalesce(_col(text), F.lit(""))), rf"(?U){SPACE}+", " ")
    return let(lambda v: _shorten(strip(v["t"]), max_len), t=flat)


def preview(text, limit: int = 320) -> Column:
    return _shorten(collapse(text), limit)


def _shorten(out: Column, limit: int) -> Column:
    return _cut(out, limit, limit - 3, "...")


def signature_text(text) -> Column:
    """Lower-case text with URLs, long hex strings and numbers as placeholders."""
    out = F.lower(F.coalesce(_col(text), F.lit("")))
    out = F.regexp_replace(out, r"(?U)(?:https?|wss?)://[^\s]+", "<url>")
    out = F.regexp_replace(out, r"(?U)\b[0-9a-f]{16,}\b", "<hash>")
    out = F.regexp_replace(out, r"(?U)\b\d+(?:\.\d+)?\b", "<n>")
    return F.substring(out, 1, 500)


def word_normalize(text) -> Column:
    """The lower-case words of a text with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), f"[^{WORD[1:-1]}]+", " "))


def numeric_tokens(text) -> Column:
    """Digits of every number, so 3.14 and 3,14 agree."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"(?U)({NUMERIC_TOKEN})"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, r"(?U)[^\d]", ""))


def _where_protected(text: Column, work, otherwise: Column) -> Column:
    """``work(pattern)`` with the cheapest pattern that finds the text's URLs and addresses; ``otherwise`` where a glance shows none.

    An address takes an ``@``; without one, its pattern would try every word in vain.
    """
    low = F.lower(text)
    return (F.when(F.contains(text, F.lit("@")), work(f"(?iU)({PROTECTED_TOKEN})"))
            .when(F.contains(text, F.lit("://")) | F.contains(low, F.lit("www.")), work(f"(?iU)({PROTECTED_URL})"))
            .otherwise(otherwise))


def protected_tokens(text) -> Column:
    """URLs and e-mail addresses, lower case, closing punctuation removed."""
    text = F.coalesce(_col(text), F.lit(""))
    found = _where_protected(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.array().cast("array<string>"))
    clean = F.transform(found, lambda t: F.lower(F.rtrim(t, F.lit(".,;:!?)]}"))))
    return F.filter(clean, lambda t: t != "")


def without_protected(text) -> Column:
    """The text with a blank for every URL and e-mail address."""
    text = F.coalesce(_col(text), F.lit(""))
    return _where_protected(text, lambda p: F.regexp_replace(text, p, " "), text)


def tokens_preserved(source: Column, target: Column) -> Column:
    """True if no token of ``source`` occurs less often in ``target``.

    Both lists in one sorted line, a token's copies in the target first: one pass counts them
    up and the source's copies down.
    """
    def side(tokens: Column, number: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(number).alias("k")))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["t"].eqNullSafe(x["t"]), acc["n"]).otherwise(0) + F.when(x["k"] == 0, 1).otherwise(-1)
        return F.struct(x["t"].alias("t"), left.alias("n"), (acc["ok"] & (left >= 0)).alias("ok"))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("ok"))
    merged = F.aggregate(F.array_sort(F.concat(side(source, 1), side(target, 0))), start, step, lambda acc: acc["ok"])
    return F.when(F.size(source) == 0, source.isNotNull()).otherwise(merged)


def shared_words(source_words: Column, target_words: Column, allowed: list[str]) -> Column:
    """Target words (repeats kept) that also are source words and not allowed."""
    return _words_also_in(frozenset(allowed))(target_words, F.array_distinct(source_words))


def _words_also_in(allowed: frozenset[str]):
    """The words of the first list over 3 letters that the second list has in any case, allowed ones left out."""
    @F.arrow_udf("array<string>")
    def also_in(words: pa.Array, others: pa.Array) -> pa.Array:
        parts = [_kept_words(words.slice(at, 256), others.slice(at, 256), allowed) for at in range(0, len(words), 256)]
        return pa.concat_arrays(parts) if parts else words

    return also_in


def _kept_words(words: pa.Array, others: pa.Array, allowed: frozenset[str]) -> pa.Array:
    """All rows at once: a word is a number, a row and a word are a number, and the numbers are looked up."""
    row, other_row = (pc.list_parent_indices(side).to_numpy() for side in (words, others))
    both = pa.concat_arrays([words.flatten(), others.flatten()]).dictionary_encode()
    known = both.dictionary
    special = pc.invert(pc.string_is_ascii(known))
    lower = pc.replace_with_mask(pc.ascii_lower(known), special, pa.array([w.lower() for w in known.filter(special).to_pylist()], known.type))
    wanted = pc.and_(pc.greater(pc.utf8_length(known), 3), pc.invert(pc.is_in(lower, pa.array(list(allowed), known.type))))
    code = np.append(lower.dictionary_encode().indices.to_numpy(), len(known))
    index = pc.fill_null(both.indices, len(known)).to_numpy()  # a null is the number after the last word
    keys = np.concatenate([row, other_row]).astype(np.int64) * (len(known) + 1) + code[index]
    found = pc.is_in(pa.array(keys[:len(row)]), pa.array(keys[len(row):])).to_numpy(zero_copy_only=False)
    keep = np.append(wanted.to_numpy(zero_copy_only=False), False)[index[:len(row)]] & found
    ends = np.cumsum(np.bincount(row[keep], minlength=len(words)))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, words.flatten().filter(pa.array(keep)), type=words.type, mask=words.is_null())


def script_chars(text, pattern: str) -> Column:
    """How many characters match ``pattern``, which stands for one character; runs of them are taken at once."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def source_script_chars(text, language) -> Column:
    """Characters of the source language's own script, 0 for other languages."""
    out = F.lit(0)
    for code, pattern in SCRIPT_RANGES.items():
        out = F.when(_col(language) == code, script_chars(text, pattern)).otherwise(out)
    return out


def cyrillic_share(text) -> Column:
    letters = script_chars(text, r"\p{L}")
    return F.when(letters > 0, script_chars(text, f"[{CYRILLIC}]") / letters).otherwise(F.lit(0.0))


def looks_like_script(text, pattern: str = f"[{CYRILLIC}]", min_letters: int = 6,
                      min_ratio: float = 0.45) -> Column:
    """At least ``min_letters`` letters of a script making up ``min_ratio`` of all letters."""
    letters, own = script_chars(text, r"\p{L}"), script_chars(text, pattern)
    return (letters > 0) & (own >= min_letters) & (own >= letters * F.lit(min_ratio))


def language_base(code) -> Column:
    return F.substring_index(F.lower(F.coalesce(_col(code), F.lit(""))), "-", 1)


def markdown_cell(value) -> Column:
    out = F.replace(F.coalesce(_col(value).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(out, r"[\r\n]", " ")


def cap_list(items: Column, n: int = 200) -> Column:
    """First ``n`` items with the full count, as a struct."""
    total = F.size(items)
    return F.struct(F.slice(items, 1, n).alias("items"), total.alias("total_count"),
                    F.least(total, F.lit(n)).alias("shown_count"), (total > n).alias("truncated"))


def split_text(text, limit: int = 3900) -> Column:
    """Parts of at most ``limit`` characters, cut after white space where the
    second half of a window has some; the parts joined give the text back."""
    text = F.coalesce(_col(text), F.lit(""))
    window_end = rf"(?sU)^(.{{0,{limit - 1}}}{SPACE})"
    half = limit // 2

    def step(state, _):
        window = F.substring(state["rest"], 1, limit)
        cut = F.length(F.regexp_extract(window, window_end, 1))
        take = F.when(F.length(state["rest"]) <= limit, F.length(state["rest"])).when(
            cut >= half, cut).otherwise(F.lit(limit))
        return F.when(state["rest"] == "", state).otherwise(F.struct(
            F.array_append(state["parts"], F.substr(state["rest"], F.lit(1), take)).alias("parts"),
            F.substr(state["rest"], take + 1).alias("rest")))

    start = F.struct(F.array().cast("array<string>").alias("parts"), text.alias("rest"))
    rounds = F.sequence(F.lit(0), F.ceil(F.length(text) / F.lit(half)).cast("int"))
    many = F.aggregate(rounds, start, step, lambda s: s["parts"])
    return F.when(text == "", F.array().cast("array<string>")).when(
        F.length(text) <= limit, F.array(text)).otherwise(many)
