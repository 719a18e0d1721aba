"""What the operators share: tables, staged steps, and texts as flat numpy arrays.

Texts reach Python as Arrow buffers. They are worked on as one array of bytes with one offset per
text, a few megabytes at a time, so a task's memory is bounded by its longest text and not by the
number of texts in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, cut_lineage, shared_dir

#: Bytes of text that are worked on at a time.
CHUNK_BYTES = 1 << 20

ODD = 0x9E3779B97F4A7C15
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, and have the shared folder set."""
    shared_dir(spark)
    return bound_batches(spark)


def table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{tables.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again: lost executors cost no work already done."""
    return cut_lineage(df, name)


def lowest_hashes(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct rows with the lowest hashes over all columns, whatever the partitions are.

    Repeated rows count once, so a hot one cannot fill the sample. Distinct rows are estimated first and
    those with clearly higher hashes go before the shuffle; what is left has about 1.2 n rows.
    """
    place = F.xxhash64(*df.columns)
    total = df.agg(F.approx_count_distinct(place, 0.02)).first()[0]
    edge = int((min(1.0, 1.2 * n / max(total, 1)) * 2 - 1) * (1 << 62)) * 2
    near = df if total <= n else df.filter(place <= F.lit(min(edge, (1 << 63) - 1)))
    return near.distinct().orderBy(place, *df.columns).limit(n)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count and len(column):
        # A null's range is empty by the format's convention, but not by its rules.
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[~valid] > 0).any():
            return text_buffers(pa.array([x.as_py() or b"" for x in column], pa.large_binary()))
    return data, offsets


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES
) -> Iterator[tuple]:
    """(rows, bytes, offsets) for runs of rows with about ``size`` bytes of text."""
    for batch in batches:
        if not len(batch):
            continue
        data, offsets = text_buffers(batch.column(text))
        first = 0
        while first < len(batch):
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), len(batch))
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x + U64(ODD)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values that differ by seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(n, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(seed * 7919 + 1))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Words end at these bytes: space and 0x09 to 0x0D.
IS_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes of all words of a run of texts, and where each text's words begin."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, U64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, text offsets into them). A-Z count as a-z; words are never cut."""
        n = len(data)
        if n + 1 > len(self.power):
            size = max(n + 1, CHUNK_BYTES + 1)
            self.power, self.inverse = _powers(BASE, size), _powers(BASE_INVERSE, size)
        inside = ~IS_GAP[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, U64)
        np.cumsum((LOWER[data].astype(U64) + U64(1)) * self.power[:n], out=sums[1:])
        hashes = mix((sums[stops] - sums[starts]) * self.inverse[starts])
        return hashes, np.searchsorted(starts, offsets)


SHINGLE_WORDS = 5


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text offsets) of all runs of five words; shorter texts are one run of what they have."""
    n = len(words)
    weights = random_words(SHINGLE_WORDS + 1, 5) | U64(1)
    runs = np.zeros(n, U64)
    for k in range(SHINGLE_WORDS):
        runs[: max(n - k, 0)] += words[k:] * weights[k]
    counts = np.diff(at)
    valid = np.ones(n, bool)
    # The last four starts of a text would reach into the next one.
    long = counts >= SHINGLE_WORDS
    for k in range(1, SHINGLE_WORDS):
        valid[at[1:][long] - k] = False
    for t in np.flatnonzero(~long & (counts > 0)):
        a, b = at[t], at[t + 1]
        valid[a + 1 : b] = False
        seed = weights[5:] * np.array([b - a], U64)
        runs[a] = np.concatenate([words[a:b] * weights[: b - a], seed]).sum()
    sizes = np.where(long, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    return mix(runs[valid]), np.concatenate([[0], np.cumsum(sizes)])


def distinct_per_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of every text, and their offsets."""
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column whose values are the rows of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())]
    )


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a binary column with values of one length as a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(-1, width)


def sorted_blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables with the rows of one key each, from batches that are sorted by it."""
    rest: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest:
            table = pa.concat_tables([*rest, table])
        codes = [table.column(c).to_numpy(zero_copy_only=False) for c in key]
        change = np.zeros(len(table), bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield table.slice(a, b - a)
        rest = [table.slice(edges[-1])]
    if rest and len(rest[0]):
        yield rest[0]
