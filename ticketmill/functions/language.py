"""Letter profiles and the language guess that rests on them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import LETTER_PROFILES, LETTERS
from .text import let


def load_profiles(spark: SparkSession) -> DataFrame:
    """The letter shares as a dimension table of 60 rows: language, letter, share."""
    rows = [
        (language, letter, share)
        for language, shares in LETTER_PROFILES.items()
        for letter, share in zip(LETTERS, shares)
    ]
    return spark.createDataFrame(rows, "language string, letter string, share double")


def letter_counts(text: Column) -> Column:
    """``array<bigint>`` with one count per letter, in the order of ``LETTERS``."""

    def count(low: Column) -> Column:
        # Byte lengths are stored with a text, character counts have to be scanned for.
        def one(ch: str) -> Column:
            gone = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(ch), F.lit("")))
            return gone if ch.isascii() else F.shiftright(gone, 1)

        return F.array(*[one(ch).cast("bigint") for ch in LETTERS])

    return let(F.lower(text), count)


def letter_frequency(counts: Column) -> Column:
    """Counts as shares of their sum; all zero when the text has no letter."""

    def share(counted: Column) -> Column:
        total = F.aggregate(counted, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
        return let(
            total,
            lambda n: F.transform(counted, lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))),
        )

    return let(counts, share)


def _sum(terms: list[Column]) -> Column:
    return reduce(add, terms)


def cosine_similarity(vector: Column, fixed: list[float]) -> Column:
    """Cosine of an array column with fixed weights, 0 where either has no length."""

    def cosine(v: Column) -> Column:
        dot = _sum([F.get(v, F.lit(i)) * F.lit(w) for i, w in enumerate(fixed)])
        norm = F.sqrt(_sum([F.get(v, F.lit(i)) * F.get(v, F.lit(i)) for i in range(len(fixed))]))
        fixed_norm = sum(w * w for w in fixed) ** 0.5
        return F.coalesce(F.try_divide(dot, norm * F.lit(fixed_norm)), F.lit(0.0))

    return let(vector, cosine)


def detect_language(df: DataFrame, text: str = "text", out: str = "language") -> DataFrame:
    """Add the guessed language: ``en`` if the text is nearer to English, else ``de``.

    Ties and texts without letters are ``de``.
    """

    def guess(shares: Column) -> Column:
        english, german = (cosine_similarity(shares, LETTER_PROFILES[n]) for n in ["en", "de"])
        return F.when(english > german, "en").otherwise("de")

    return df.withColumn(out, let(letter_frequency(letter_counts(F.col(text))), guess))
