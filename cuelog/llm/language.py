"""Language identification by compression: the dictionary that shrinks a text most names its language."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns

#: Letters, as in the SQL filter of the training rows: digits, fractions and Roman numerals are none.
_LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and the coder's settings."""
    sample_docs: int = 400         # documents of a language in the sample, at most
    dictionary_bytes: int = 48 << 10  # of a language's raw-content dictionary, at most
    slice_chars: int = 2000        # of one document in the sample, at most
    block_chars: int = 2000        # a text is coded in blocks of so many characters
    level: int = 6
    min_margin: float = 0.01       # below, the choice is marked as rejected


def letters(text: str) -> str:
    """The runs of letters, lower-cased, one space between them."""
    return " ".join(_LETTERS.findall(text)).lower()


def train(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Language -> dictionary content, from ``doc_id``, ``text`` and ``lang``.

    A bounded sample: of every language the ``sample_docs`` different rows with the smallest hashes of id and text,
    ``slice_chars`` of each, ``dictionary_bytes`` in all.  Repeated rows count once, and null ids are ids
    like others.  A threshold from the number of different rows keeps most rows out of the shuffle; the choice does
    not depend on partitions.  Rows with a null language or text, or without letters, teach nothing.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    span = float(1 << 63)
    share = {lang: min(1.0, 2 * settings.sample_docs / n) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for lang, p in share.items() for x in (lang, min((1 << 63) - 1, int((2 * p - 1) * span)))])
    near = usable.filter(F.col("h") <= limit[F.col("lang")]).select("lang", "h", F.substring("text", 1, settings.slice_chars).alias("text")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = near.withColumn("_n", place).filter(F.col("_n") <= settings.sample_docs).drop("_n").collect()
    counted: dict[str, Counter] = {lang: Counter() for lang in counts}
    for row in rows:
        counted[row.lang].update(letters(row.text).split())
    return {lang: _content(words, settings.dictionary_bytes) for lang, words in sorted(counted.items()) if words}


def _content(words: Counter, most: int) -> bytes:
    """The most frequent words that fit, rarest first."""
    kept, size = [], 0
    for word, _ in sorted(words.items(), key=lambda w: (-w[1], w[0])):
        size += len(word.encode()) + 1
        if size > most:
            break
        kept.append(word)
    return " ".join(reversed(kept)).encode()


class Classifier:
    """Compressors, one a language, each with its dictionary loaded once."""

    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings = settings
        self.languages = sorted(dictionaries)
        self.coders = []
        for lang in self.languages:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(settings.level, dict_size=len(dictionaries[lang]), source_size=settings.block_chars, min_match=3,
                                                                 write_checksum=False, write_content_size=False, write_dict_id=False)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        """Coded bytes of the whole text under each language."""
        plain = letters(text)
        step = self.settings.block_chars
        blocks = [plain[i:i + step].encode() for i in range(0, len(plain), step)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.languages or not text or not _LETTERS.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.languages[i]))
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = 1 - sizes[best] / min(rest) if rest else 1.0
        return self.languages[best], min(1.0, max(0.0, margin)), margin < self.settings.min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, from ``text`` alone.

    The language whose dictionary codes the whole text smallest (the first by name of
    equals); ``score`` is the share of bytes it saves over the runner-up, and a score under
    ``min_margin`` is marked as rejected.  A null text or one without a letter is ``und``,
    score 0, rejected; so is every text if nothing was learned.

    The dictionaries are bounded by ``dictionary_bytes`` for each language, and sent to every worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        classifier = Classifier(sent.value, settings)

        def work(batch):
            found = [classifier.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return work

    return append_columns(docs, make, "lang_pred string, score double, rejected boolean")
