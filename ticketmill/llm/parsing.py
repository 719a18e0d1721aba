"""Document fingerprints by locally consistent parsing.

A text is cut into phrases, the phrases get names, the names are cut into phrases again, and so on
until one name is left. Where a phrase begins depends on a few symbols to its left and one to its
right only: runs of one symbol count as one, deterministic coin tossing (twice the place of the lowest
bit in which a symbol differs from the one before, plus that bit) brings the symbols down to six
values of which neighbours differ, and a phrase begins at every local maximum. A phrase's name is a
hash of what it holds. So equal stretches of two texts are cut alike, wherever they stand, but for
phrases next to their ends, on every level.

A fingerprint is the name of the whole text and the smallest ``SIZE`` of its phrase names (a bottom-k
sketch) from that level on at which phrases are long enough to mean something. Two fingerprints are
alike by the share of names they have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, prepare, random_words, text_buffers, text_chunks
from .memory import ramp

#: Names in a fingerprint at most.
SIZE = 64
#: Names count from level 3 (some 30 bytes) on, in texts below the bytes given from level 2 or 1 on.
SHORT, SHORTEST = 512, 64
#: Bytes of text that are parsed at a time.
RUN_BYTES = 1 << 19
#: Bytes of text in a part of the ordered documents, parts at most, and keys that place their bounds.
PART_BYTES = 8 << 20
MOST_PARTS = 1 << 16
SAMPLE_KEYS = 1 << 16

WEIGHTS = random_words(64, 17) | U64(1)
LENGTHS = random_words(64, 18)
WORD_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
NOTHING = np.uint32(0xFFFFFFFF)


def _tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from the one before, plus the symbol's bit there.

    A text's first symbol is held against its opposite.
    """
    one = symbols.dtype.type(1)
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = before ^ symbols
    low = differ & (~differ + one)
    place = np.bitwise_count(low - one)
    return (place << np.uint8(1)) | ((symbols & low) != 0)


def _begins(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at a text's first symbol and at local maxima inside it."""
    up = labels[1:] > labels[:-1]
    peak = np.zeros(len(labels), bool)
    peak[1:-1] = up[:-1] & (labels[1:-1] > labels[2:])
    peak[first - 1] = False  # a text's last symbol; at 0 the wrap meets the last one of all
    peak[first] = True
    return np.flatnonzero(peak)


def _named(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of phrases of some eleven symbols at most."""
    sizes = np.diff(begins, append=len(values))
    place = np.arange(len(values), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes)
    return mix(np.add.reduceat(values * WEIGHTS[place], begins) + LENGTHS[sizes])


def _named_bytes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of phrases of bytes; only those with a run in them are longer than two words of eight."""
    sizes = np.diff(begins, append=len(data))
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(data) + 9,), (1,))
    sums = (words[begins] & WORD_MASKS[np.minimum(sizes, 8)]) * WEIGHTS[0] + LENGTHS[np.minimum(sizes, 63)]
    more = np.flatnonzero(sizes > 8)
    second = words[begins[more] + 8] & WORD_MASKS[np.minimum(sizes[more] - 8, 8)]
    sums[more] += second * WEIGHTS[1]
    for i in more[sizes[more] > 16].tolist():
        whole = hashlib.blake2b(data[begins[i] : begins[i] + sizes[i]], digest_size=8).digest()
        sums[i] = int.from_bytes(whole, "little")
    return mix(sums)


def _collapsed(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol inside a text as one: (where they begin, lengths, first symbols of texts)."""
    change = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    change[first] = True
    at = np.flatnonzero(change)
    return at, np.diff(at, append=len(symbols)), np.searchsorted(at, first)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Phrases of every text of a run: (text numbers, names) per level from 1 on, and the texts' names.

    ``data`` holds the UTF-8 bytes of all texts, ``offsets`` where they begin and end. The name of an
    empty text is 0.
    """
    roots = np.zeros(len(offsets) - 1, U64)
    texts = np.flatnonzero(np.diff(offsets))
    if not len(texts):
        return [], roots
    at, _, first = _collapsed(data, offsets[texts])
    symbols, levels = data[at], []
    while True:
        labels = _tossed(symbols, first)
        for _ in range(3 if symbols.dtype == U64 else 2):
            labels = _tossed(labels, first)
        begins = _begins(_tossed(labels, first), first)
        names = _named(symbols, begins) if levels else _named_bytes(data, at[begins])
        first = np.searchsorted(begins, first)
        counts = np.diff(first, append=len(names))
        levels.append((np.repeat(texts, counts), names))
        at, sizes, first = _collapsed(names, first)
        symbols = names
        if len(at) < len(names):
            symbols, runs = names[at], sizes > 1
            symbols[runs] = mix(symbols[runs] + sizes[runs].astype(U64))
            counts = np.diff(first, append=len(symbols))
        done = counts == 1
        if done.any():
            roots[texts[done]] = symbols[first[done]]
            if done.all():
                return levels, roots
            symbols, texts, counts = symbols[np.repeat(~done, counts)], texts[~done], counts[~done]
            first = np.cumsum(counts) - counts


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first level that counts, text names, matrix of the smallest names) of the texts of a run.

    A row of the matrix is sorted and filled up with ``NOTHING``. The last two bits of a name tell its
    level (3 for all higher ones).
    """
    size = np.diff(offsets)
    base = np.where(size >= SHORT, 3, np.where(size >= SHORTEST, 2, 1)) * (size > 0)
    levels, roots = parse(data, offsets)
    out = np.full((len(size), SIZE), NOTHING, np.uint32)
    of, values = [], []
    for number, (texts, names) in enumerate(levels, 1):
        kind = min(number, 3)
        counted = base[texts] <= number
        of.append(texts[counted])
        values.append((names[counted] >> U64(34)).astype(np.uint32) << np.uint32(2) | np.uint32(kind))
    # The whole is a phrase too; it may stand below the first level that counts.
    whole = np.flatnonzero(size)
    of.append(whole)
    values.append((roots[whole] >> U64(34)).astype(np.uint32) << np.uint32(2) | np.uint32(3))
    # (text, value) as one number: texts of a run are few enough for 31 bits.
    both = np.sort((np.concatenate(of).astype(U64) << U64(32)) | np.concatenate(values))
    both = both[np.diff(both, prepend=~both[:1]) != 0]
    of = (both >> U64(32)).astype(np.int64)
    at = np.searchsorted(of, np.arange(len(size) + 1))
    place = ramp(np.diff(at))
    kept = place < SIZE
    out[of[kept], place[kept]] = (both[kept] & U64(0xFFFFFFFF)).astype(np.uint32)
    return base, roots, out


def written(base: np.ndarray, roots: np.ndarray, names: np.ndarray) -> list[str]:
    """Fingerprints as strings: the first level, the text's name in hex, its smallest names."""
    counts = (names != NOTHING).sum(axis=1)
    return [
        f"{b}{r:016x}{base64.b64encode(row[:n].astype('>u4').tobytes()).decode()}"
        for b, r, row, n in zip(base.tolist(), roots.tolist(), names, counts.tolist())
    ]


def read(fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``written`` wrote; a null is the fingerprint of an empty text."""
    fingerprints = [x or "0" + "0" * 16 for x in fingerprints]
    names = np.full((len(fingerprints), SIZE), NOTHING, np.uint32)
    for row, x in zip(names, fingerprints):
        own = np.frombuffer(base64.b64decode(x[17:]), ">u4")
        row[: len(own)] = own
    return (
        np.array([int(x[0]) for x in fingerprints], np.int64),
        np.array([int(x[1:17], 16) for x in fingerprints], U64),
        names,
    )


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """Share of names that two fingerprints have in common, row by row: 2 |A and B| / (|A| + |B|).

    A full sketch knows the names up to its largest one; the share is taken among the names up to which
    both know all, which stand for the rest. Only levels that count in both are looked at. Texts of one
    name are alike by 1, also two empty ones.
    """
    base = np.maximum(a[0], b[0])[:, None]
    sides, known = [], np.full(len(a[0]), NOTHING)
    for _, _, names in (a, b):
        known = np.minimum(known, names[:, -1])
        sides.append(np.where((names & np.uint32(3)) >= base, names, NOTHING))
    merged = np.sort(np.concatenate(sides, axis=1), axis=1)
    real = (merged != NOTHING) & (merged <= known[:, None])
    total = real.sum(axis=1)
    shared = (real[:, 1:] & (merged[:, 1:] == merged[:, :-1])).sum(axis=1)
    same = (a[1] == b[1]) & (a[0] == b[0])
    return np.where(same, 1.0, 2 * shared / np.maximum(total, 1))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; a null counts as an empty text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        data, offsets = text_buffers(pa.array(texts, pa.string(), from_pandas=True))
        return pd.Series(written(*sketches(data[offsets[0] : offsets[-1]], offsets - offsets[0])), dtype=object)

    return run(text)


def alike(a: Column, b: Column) -> Column:
    """How much two columns of fingerprints are alike, 0 to 1."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(likeness(read(left), read(right)))

    return run(a, b)


KEY = [("none", "i1"), ("id", "i8"), ("text", "i8")]


def _keys(rows) -> np.ndarray:
    out = np.array([tuple(r) for r in rows], dtype=KEY) if len(rows) else np.zeros(0, KEY)
    return np.sort(out)


def _in_parts(docs: DataFrame) -> DataFrame:
    """Documents by part of their order, with the first document of the next part as a guest in each.

    The order is a descending doc_id, rows without one last, ties by a hash of the text. Parts hold
    about ``PART_BYTES`` of text; bounds come from a sample of keys, which decides only what lies
    where. The driver gets that sample and one key per part.
    """
    keyed = docs.select(
        F.col("doc_id").isNull().cast("tinyint").alias("_none"),
        F.expr("~coalesce(bigint(doc_id), 0L)").alias("_id"),
        F.xxhash64("text").alias("_text"),
        F.col("doc_id").cast("bigint"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = ["_none", "_id", "_text"]
    size = F.octet_length("text").cast("bigint")
    total, rows = keyed.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    parts = min(-(-total // PART_BYTES), MOST_PARTS) or 1
    bounds = np.zeros(0, KEY)
    if parts > 1:
        share = min(1.0, SAMPLE_KEYS / rows)
        seen = F.pmod(F.xxhash64(F.lit(11), *key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        sample = keyed.filter(seen).select(*key, size.alias("size")).distinct().toPandas()
        sample = sample.sort_values(key)
        past = sample["size"].cumsum().to_numpy() / max(sample["size"].sum(), 1)
        cuts = np.unique(np.searchsorted(past, np.arange(1, parts) / parts))
        bounds = _keys(sample[key].to_numpy()[cuts[cuts < len(sample)]].tolist())

    def numbers(none, id_, text) -> np.ndarray:
        rows = np.empty(len(none), KEY)
        rows["none"], rows["id"], rows["text"] = none, id_, text
        return rows

    @F.pandas_udf("int")
    def part(none: pd.Series, id_: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, numbers(none, id_, text), "right").astype(np.int32))

    lowest = F.min(F.struct(*key)).alias("k")
    # One row per part.
    tops = sorted((p, tuple(k)) for p, k in keyed.groupBy(part(*key).alias("p")).agg(lowest).collect())
    firsts = _keys([k for _, k in tops])
    host = np.array([tops[i - 1][0] for i in range(len(tops))], np.int32)

    @F.pandas_udf("array<int>")
    def places(none: pd.Series, id_: pd.Series, text: pd.Series) -> pd.Series:
        """The own part, and as -1 - part the one in which the row is a guest."""
        rows = numbers(none, id_, text)
        own = np.searchsorted(bounds, rows, "right")
        at = np.minimum(np.searchsorted(firsts, rows), len(firsts) - 1)
        guest = firsts[at] == rows
        return pd.Series([[o, -1 - host[i]] if g else [o] for o, i, g in zip(own.tolist(), at, guest)])

    placed = keyed.withColumn("_place", F.explode(places(*key)))
    guest = F.col("_place") < 0
    placed = placed.withColumns(
        {"_guest": guest, "_part": F.when(guest, -1 - F.col("_place")).otherwise(F.col("_place"))}
    )
    dealt = placed.repartitionById(len(bounds) + 1, F.col("_part"))
    return dealt.sortWithinPartitions("_part", "_guest", *key)


SCHEMA = """doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,
    edited_fingerprint string, near_edited double, near_next double"""


class Texts:
    """Texts of a run with the byte at which any of their characters begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.raw = data, offsets, data.tobytes()
        self.starts = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.starts, offsets)
        self.n_chars = np.diff(self.first)

    def head(self, text: int, n: int) -> bytes:
        """The first ``n`` characters of a text, or all."""
        at = self.first[text] + n
        end = self.starts[at] if n < self.n_chars[text] else self.offsets[text + 1]
        return self.raw[self.offsets[text] : end]


def _compared(ids: list, texts: Texts) -> tuple[pa.RecordBatch, int]:
    """Result rows for all texts of a run but the last, which is only somebody's next."""
    base, roots, names = sketches(texts.data, texts.offsets)
    edited = []
    for i in range(len(ids) - 1):
        n = int(texts.n_chars[i])
        edited.append(texts.head(i, n - n // 2) + texts.head(i + 1, n // 2))
    sizes = np.fromiter(map(len, edited), np.int64, len(edited))
    data = np.frombuffer(b"".join(edited), np.uint8)
    changed = sketches(data, np.concatenate([[0], np.cumsum(sizes)]))
    own, after = (base[:-1], roots[:-1], names[:-1]), (base[1:], roots[1:], names[1:])
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array(texts.n_chars[:-1], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(written(*own), pa.string()),
        pa.array(written(*changed), pa.string()),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]
    names_ = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
    return pa.RecordBatch.from_arrays(columns, names_)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of sorted parts; the last row of a part is its guest, which gives no row.

    Rows are taken in runs; the last row of a run opens the next one.
    """
    open_: tuple | None = None  # (part, id, bytes) of the row that still waits for its next
    ended = None  # the part whose guest has been seen
    for rows, data, offsets in text_chunks(batches, size=RUN_BYTES):
        parts = rows.column("_part").to_numpy()
        guests = rows.column("_guest").to_numpy(zero_copy_only=False)
        ids = rows.column("doc_id").to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(ids)]
        for a, b in zip(edges[:-1], edges[1:]):
            if ended == parts[a]:  # copies of the guest
                continue
            stop = a + int(np.argmax(guests[a:b])) + 1 if guests[a:b].any() else b
            own, at = ids[a:stop], offsets[a : stop + 1]
            part = data[at[0] : at[-1]]
            at = at - at[0]
            if open_ is not None and open_[0] == parts[a]:
                own = [open_[1], *own]
                part = np.concatenate([open_[2], part])
                at = np.concatenate([[0], at + len(open_[2])])
            if len(own) > 1:
                yield _compared(own, Texts(part, at))
            open_ = (parts[a], own[-1], part[at[-2] :].copy())
            if guests[a:b].any():
                open_, ended = None, parts[a]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of edited texts, and how alike neighbours are.

    The next document of a row is the one that follows by descending doc_id; after the last comes the
    first. The edited text has its last half (floor of half the code points) replaced by as many code
    points from the start of the next document, or all it has. A result row has ``n_chars``,
    ``edited_sha256`` (of the UTF-8 bytes), both fingerprints, and the likeness of the text's
    fingerprint to the edited text's and to the next document's.

    A null text counts as an empty one. Rows without an id come last; rows of one id are ordered by a
    hash of their texts. A table of one row is its own next. Columns other than doc_id and text are not
    looked at. No rows, no result. Texts are compared as whole texts, half a megabyte at a time, so a
    task needs the memory of its longest text.
    """
    prepare(docs.sparkSession)
    return _in_parts(docs).select("doc_id", "text", "_part", "_guest").mapInArrow(_with_next, SCHEMA)
