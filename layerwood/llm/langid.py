"""Language identification by compression.

Every language has a raw-content zstandard dictionary of its own words.  A text
is compressed with each of them; the language whose dictionary makes it smallest
wins.  The score reads the sizes as code lengths: two to the power of minus the
bits, over the sum of that over all languages.  Texts whose two smallest sizes
are nearly equal are rejected.

The dictionaries are fitted on a bounded sample: of each language the
``docs_per_language`` different texts whose checksums are smallest.  They are cut
whole into pieces of ``excerpt`` characters; a
dictionary holds different pieces up to ``dictionary_bytes``, one of every text
first, chosen by hash, then a second one of every text, and so on.  At most ``max_languages``
languages are allowed, so what is sent to the tasks has a bound.  Texts to be
identified are compressed whole, in pieces of ``PIECE`` bytes whose sizes are added.

Defined cases: null texts and texts without a letter get ``und``, score 0; equal
sizes go to the language with more training rows, then by code point; null and
empty language labels are not learned; without any label every text is ``und``;
further columns stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bytes of a text that meet the dictionaries at once; more would learn from one another rather than from them.
PIECE = 10 << 10
NOT_LETTERS = re.compile(r"[\W\d_]+")
GUESS = "lang string, score double, margin double"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the one with most training rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 7
    min_margin: float = 0.01


def letters_of(text: str) -> bytes:
    return f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "replace")


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  docs_per_language: int = 200, excerpt: int = 512, dictionary_bytes: int = 64 << 10,
                  max_languages: int = 256, level: int = 7, min_margin: float = 0.01) -> LanguageModel:
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                       F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("draw"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != ""))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # texts are told apart by hash, so only narrow rows are shuffled; the rank limit is applied in every task before
    rows = rows.withColumn("content", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("draw", "content")
    chosen = (rows.groupBy("lang", "content").agg(F.min("draw").alias("draw"))
              .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= docs_per_language).drop("nth"))
    texts = rows.join(F.broadcast(chosen), ["lang", "content", "draw"]).dropDuplicates(["lang", "content"])
    number = F.ceil(F.char_length("text") / excerpt).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda i: F.struct(F.xxhash64("draw", "content", i).alias("by"), i.alias("i")))
    # no text can give more than a whole dictionary
    places = F.slice(F.array_sort(places), 1, dictionary_bytes // excerpt + 1)
    pieces = texts.select("lang", "draw", "content", "text", F.posexplode(places).alias("turn", "place"))
    pieces = pieces.select("lang", "draw", "content", "turn", F.substring("text", (F.col("place.i") - 1) * excerpt + 1, F.lit(excerpt)).alias("piece"))
    pieces = pieces.groupBy("lang", "piece").agg(F.min(F.struct("turn", "draw", "content")).alias("at"))
    # twice the bytes, as runs of other characters than letters become blanks
    before = F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    sample = pieces.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * dictionary_bytes).collect()
    bags: dict[str, list] = {}
    for row in sorted(sample, key=lambda r: r["before"]):
        bags.setdefault(row["lang"], []).append(letters_of(row["piece"]))
    return LanguageModel(tuple((r["lang"], b"".join(bags[r["lang"]])[:dictionary_bytes]) for r in counts), level, min_margin)


@lru_cache(maxsize=2)
def compressors(model: LanguageModel) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for name, content in model.dictionaries:
        # too short a content cannot be a dictionary
        held = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(model.level)
        made.append((name, zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False)))
    return made


def identify(text: str | None, model: LanguageModel) -> tuple[str, float, float]:
    """Language, score and margin: how much larger the second size is, as a share of the smallest."""
    held = compressors(model)
    if not text or not held:
        return UNKNOWN, 0.0, 0.0
    data = letters_of(text)
    if not any(map(str.isalpha, data.decode("utf-8", "replace"))):
        return UNKNOWN, 0.0, 0.0
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in held]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for i, s in enumerate(sizes) if i != best]
    odds = sum(2.0 ** max(-1000, 8 * (sizes[best] - s)) for s in rest)
    return held[best][0], 1.0 / (1.0 + odds), (min(rest) / sizes[best] - 1.0) if rest else 1.0


def guess(model: LanguageModel, text: Column) -> Column:
    """A struct of lang, score and margin of a text column."""

    @F.pandas_udf(GUESS)
    def identified(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(t, model) for t in texts], columns=["lang", "score", "margin"])

    return identified(text)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score, margin and rejected (a letter there, but the margin is too narrow)."""
    rows = docs.withColumn("_guess", guess(model, F.col(text)))
    return rows.withColumns({"lang_pred": F.col("_guess.lang"), "score": F.col("_guess.score"), "margin": F.col("_guess.margin"),
                             "rejected": (F.col("_guess.lang") != UNKNOWN) & (F.col("_guess.margin") < model.min_margin)}).drop("_guess")
