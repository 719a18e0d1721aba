"""Language ID with n-gram filters whose cells are bitmasks of languages.

Training counts the n-grams of every language and keeps those with at least ``MIN_SHARE`` of its
occurrences, so 1 / MIN_SHARE of them at most. All languages share one Bloom filter of bit slices: a
cell has a bit per language, an n-gram sets the language's bit in its cells. Reading an n-gram is an
AND over its cells and gives all languages that have it at once. A text's hits are counted per
language and corrected for the share that the language's slice returns by chance; the language with
the most corrected hits wins.

An n-gram is four bytes of the UTF-8 text. A-Z and the capitals of Latin-1 count as small, other
ASCII than letters as blanks, and a blank may stand at the ends of an n-gram only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, prepare, staged, text_chunks

GRAM_BYTES = 4
MIN_SHARE = 5e-5
HASHES = 4
CELLS_PER_GRAM = 10
#: Distinct (language, n-gram) pairs that a task gathers before it hands them on.
GATHERED = 1 << 20
UNDETERMINED = "und"
#: Languages whose n-grams are collected at a time, those of one word of the bitmask.
GROUP = 64

_BYTES = np.arange(256)
_IS_SMALL = (_BYTES >= 0x61) & (_BYTES <= 0x7A)
_IS_LARGE = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
FOLD = np.where(_IS_LARGE, _BYTES + 32, np.where(_IS_SMALL | (_BYTES >= 0x80), _BYTES, 0x20)).astype(np.uint8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, index of the text) of all n-grams; none reaches from one text into the next."""
    texts = len(offsets) - 1
    # A blank at both ends of every text, so that its first and last words end like all others.
    data = np.insert(data, np.repeat(offsets, 2)[1:-1], 0x20)
    offsets = offsets + 2 * np.arange(texts + 1)
    n = len(data) - GRAM_BYTES + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    folded = FOLD[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    folded[1:][capital] += 0x20
    codes = np.zeros(n, np.uint32)
    for k in range(GRAM_BYTES):
        codes |= folded[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    text = np.repeat(np.arange(texts), np.diff(offsets))
    valid = text[:n] == text[GRAM_BYTES - 1 :]
    for k in range(1, GRAM_BYTES - 1):
        valid &= folded[k : k + n] != 0x20
    return codes[valid], text[:n][valid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's texts, added up as far as memory is bounded."""
    names: list[str] = []
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        lang = (keys >> U64(32)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(lang)),
                pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)),
                pa.array(counts),
            ],
            ["lang", "gram", "n"],
        )

    for batch, data, offsets in text_chunks(batches):
        langs = batch.column("lang").to_pylist()
        names += sorted(set(langs) - set(names))
        codes, text = ngrams(data, offsets)
        lang = np.array([names.index(x) for x in langs], U64)[text]
        new, n = np.unique((lang << U64(32)) | codes.astype(U64), return_counts=True)
        merged, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        keys = merged
        if len(keys) > GATHERED:
            yield rows()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield rows()


class Filters:
    """The bit-sliced filter of all languages, and each slice's rate of chance hits."""

    def __init__(self, grams: dict[str, np.ndarray], docs: dict[str, int], largest: int = 0):
        """``largest``: the most n-grams of a language, also of those that ``fill`` brings later."""
        self.names = sorted(docs)
        self.usual = min(self.names, key=lambda x: (-docs[x], x), default=UNDETERMINED)
        largest = max(largest, *map(len, grams.values()), 1)
        self.size = 1 << max(6, int(np.ceil(np.log2(max(1, CELLS_PER_GRAM * largest)))))
        self.cells = np.zeros(((len(self.names) + 63) // 64, self.size), U64)
        self.chance = np.zeros(len(self.names))
        self.fill(grams)

    def fill(self, grams: dict[str, np.ndarray]) -> None:
        """Set the languages' bits in the cells of their n-grams."""
        places = {name: i for i, name in enumerate(self.names)}
        for name, codes in grams.items():
            i = places[name]
            bit = U64(1) << U64(i % 64)
            for at in self.places(codes):
                self.cells[i // 64][at] |= bit
            self.chance[i] = ((self.cells[i // 64] & bit) > 0).mean() ** HASHES

    def places(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(codes.astype(U64))
        step = (h >> U64(32)) | U64(1)
        for _ in range(HASHES):
            yield (h & U64(self.size - 1)).astype(np.int64)
            h = h + step

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Per n-gram, the languages that have it, 64 to a row."""
        out = np.full((len(self.cells), len(codes)), U64(0xFFFFFFFFFFFFFFFF))
        for at in self.places(codes):
            for row, cells in zip(out, self.cells):
                row &= cells[at]
        return out

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, corrected share of hits) per text; without a hit, the most usual language."""
        codes, text = ngrams(data, offsets)
        texts = len(offsets) - 1
        total = np.bincount(text, minlength=texts)
        hits = np.zeros((texts, max(1, len(self.names))))
        masks = self.masks(codes)
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        for i in range(len(self.names)):
            if len(starts):
                bits = ((masks[i // 64] >> U64(i % 64)) & U64(1)).astype(np.int32)
                found = np.add.reduceat(bits, starts)
                hits[text[starts], i] = found
        if len(self.names):
            hits = (hits - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9)
        share = np.clip(hits / np.maximum(total, 1)[:, None], 0, 1)
        best = share.argmax(axis=1)  # ties go to the first by name
        score = share[np.arange(texts), best]
        names = [self.names[b] if s > 0 else self.usual for b, s in zip(best, score)]
        return names, score


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows of ``docs`` that have a language; texts may be null or empty.

    The counting covers every row. N-grams are collected by groups of 64 languages, 64 / MIN_SHARE rows
    at most; the filters take 32 KB per language on the driver and in a worker, for any number of them.
    """
    prepare(docs.sparkSession)
    rows = docs.selectExpr(f"`{text}` AS text", f"`{lang}` AS lang").filter("lang IS NOT NULL")
    languages = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = staged(
        rows.mapInArrow(_count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= MIN_SHARE * F.col("total"))
    frequent = frequent.select("lang", "gram")
    if len(languages) > GROUP:
        frequent = staged(frequent, "frequent")
        sizes = frequent.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        filters = Filters({}, languages, sizes)
        for first in range(0, len(filters.names), GROUP):
            names = filters.names[first : first + GROUP]
            filters.fill(_by_language(frequent.filter(F.col("lang").isin(names))))
        return filters
    return Filters(_by_language(frequent), languages)


def _by_language(grams: DataFrame) -> dict[str, np.ndarray]:
    rows = grams.toPandas()
    return {name: own.to_numpy().astype(np.uint32) for name, own in rows.groupby("lang").gram}


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
    Every text is read whole; equal texts get equal results, and ties go to the first name.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vars(filters))  # bounded, see ``learn``
    docs = docs.drop("lang_pred", "lang_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters.__new__(Filters)
        vars(own).update(shared.value)
        for rows, data, offsets in text_chunks(batches, text):
            names, score = own.decide(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                [*rows.schema.names, "lang_pred", "lang_score"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    found = docs.mapInArrow(run, f"{schema}, lang_pred string, lang_score double")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumns(
        {
            "lang_score": F.when(letters, F.col("lang_score")).otherwise(0.0),
            "lang_pred": F.when(letters, F.col("lang_pred")).otherwise(UNDETERMINED),
        }
    )
