"""Documents packed into sequences: dominance reduction, then best fit, on counts of lengths.

Pieces of one length are interchangeable, so the instance is a histogram with at most ``capacity``
rows, however many documents there are. It is reduced after Martello and Toth: taking the longest
piece first, a set of at most three pieces that dominates every other set with that piece is fixed
for good. What remains is packed by best fit, longest first. Both work on whole runs of equal
sequences. The plan says, for the r-th piece of a length, which sequence takes it and where; the
pieces get their places from it in parallel.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, staged, text_chunks
from .memory import Memory, ramp

CAPACITY = 2048
#: Parts into which the pieces of one length are counted, so that no length lands in one task.
PARTS = 1024

#: Letters that compose and lower to single letters, and ASCII that is neither letter, blank nor
#: apostrophe.
LETTER = "a-zÀ-ÖØ-öø-įı-ɏ"
MARK = "\\x21-\\x26\\x28-\\x40\\x5b-\\x60\\x7b-\\x7e"
#: Runs that the tokenizer's own pattern never reaches across: letters before an ASCII mark, marks
#: before a letter, and else all up to the next blank.
WORDS = re.compile(
    f"[{LETTER}]+(?=[{MARK}' \\n\\t\\r]|$)|[{MARK}]+(?=[{LETTER} \\n\\t\\r]|$)|[^ \\n\\t\\r]+"
)
BLANKS = re.compile("[^ \\n\\t\\r]+")


def cut(text: str) -> list[str]:
    """Words of a text that can be encoded apart; ASCII-lowered, unless it has "<|"."""
    return (BLANKS if "<|" in text else WORDS).findall(text)


def words_of(raw: bytes) -> list[str]:
    """Words of a UTF-8 text that can be encoded apart.

    ASCII is lowered, so that more words are met again; the tokenizer lowers the rest. It looks for
    its added tokens first and with case, so a text that may have one stays as it is.
    """
    return cut((raw if b"<|" in raw else raw.lower()).decode("utf-8", "replace"))


def word_encoder(path: str):
    """words -> (ids, offsets), by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    return run


def tokenize(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids): every text's ids and the end id, cut only where too long.

    ``ids`` holds unsigned 32-bit little-endian numbers. A null text counts as an empty one and is
    one piece with the end id alone. Repeated rows give repeated pieces.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({})  # a place that outlives a worker's task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "memory" not in shared.value:
            shared.value["memory"] = Memory(word_encoder(path))
        memory = shared.value["memory"]
        for rows, data, offsets in text_chunks(batches):
            raw = data.tobytes()
            texts = [words_of(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids, at = memory.encode(texts)
            ids = np.insert(ids, at[1:], end).astype("<u4")
            sizes = np.diff(at) + 1
            at = np.cumsum(sizes) - sizes
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(rows)), pieces)
            piece = ramp(pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            blob = ids.tobytes()
            begin = (4 * (at[doc] + start)).tolist()
            stop = (4 * (at[doc] + start + length)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id").cast(pa.int64()).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([blob[a:b] for a, b in zip(begin, stop)], pa.binary()),
                ],
                ["id", "piece", "start", "length", "ids"],
            )

    return docs.selectExpr(f"`{id_column}` AS id", f"`{text}` AS text").mapInArrow(
        run, "id bigint, piece int, start bigint, length bigint, ids binary"
    ).withColumnRenamed("id", id_column)


class Plan:
    """Sequences handed out in runs; every entry gives pieces of one length their places.

    An entry (length, rank, count, sequence, each, offset) says: of the pieces of this length, those
    from ``rank`` on go to ``count`` sequences from ``sequence`` on, ``each`` side by side from
    ``offset`` on.
    """

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.used = dict.fromkeys(self.counts, 0)
        self.entries: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append((length, self.used[length], count, sequence, each, offset))
        self.used[length] += count * each
        self.counts[length] -= count * each
        if not self.counts[length]:
            del self.counts[length]

    def fix(self, lengths: list[int]) -> None:
        """As many sequences with exactly these pieces as there are pieces for."""
        need = {n: lengths.count(n) for n in lengths}
        count = min(self.counts[n] // k for n, k in need.items())
        first, offset = self.open(count), 0
        for n, k in need.items():
            self.place(n, count, first, k, offset)
            offset += n * k


def _dominating(counts: dict[int, int], order: list[int], longest: int, capacity: int) -> list[int] | None:
    """A set with the longest piece that dominates all feasible ones, or None.

    A set dominates another if each piece of the other can be put in place of a piece of its own
    that is at least as long; then some best packing has it (Martello and Toth 1990).
    """

    def left(n: int, taken: list[int]) -> int:
        return counts[n] - taken.count(n)

    def largest(room: int, taken: list[int]) -> int | None:
        at = bisect.bisect_right(order, room)
        while at and left(order[at - 1], taken) <= 0:
            at -= 1  # only lengths in ``taken`` are skipped, two at most
        return order[at - 1] if at else None

    smallest, taken = [], [longest]
    for n in order:
        smallest += [n] * min(left(n, taken), 3 - len(smallest))
        if len(smallest) == 3:
            break
    room = capacity - longest
    if not smallest or smallest[0] > room:
        return [longest]
    first = largest(room, taken)
    if first == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [longest, first]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None  # sets of four or more are not looked at
    second = largest(room - first, [longest, first])
    if second is None:
        return None
    # With at most two partners, (first, second) dominates if no other pair has a longer second.
    for n in reversed(order[: bisect.bisect_left(order, first)]):
        if n <= second:
            break
        other = largest(min(room - n, n), [longest, n])
        if other is not None and other > second:
            return None
    return [longest, first, second]


def reduce_dominated(plan: Plan, capacity: int) -> None:
    """Fix dominating sets, longest pieces first, until no length has one."""
    while plan.counts:
        order = sorted(plan.counts)
        progress = False
        for longest in reversed(order):
            if longest not in plan.counts:
                continue
            present = [n for n in order if n in plan.counts]
            lengths = _dominating(plan.counts, present, longest, capacity)
            if lengths is not None and any(
                lengths.count(n) > plan.counts[n] for n in lengths
            ):
                lengths = None
            if lengths is None:
                continue
            plan.fix(lengths)
            progress = True
        if not progress:
            break


def best_fit(plan: Plan, capacity: int) -> None:
    """Longest pieces first, each into the fullest sequence that still has room."""
    rooms: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)

    def add(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count))

    for length in sorted(plan.counts, reverse=True):
        while length in plan.counts:
            need = plan.counts[length]
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, each = capacity, capacity // length
                count = max(1, need // each)
                first = plan.open(count)
            else:
                room = rooms[at]
                each = room // length
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            if need < each:
                each = need
            take = min(count, need // each)
            plan.place(length, take, first, each, capacity - room)
            add(room - each * length, first, take)
            add(room, first + take, count - take)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for all pieces of a histogram of lengths (1 to ``capacity``)."""
    plan = Plan(counts)
    reduce_dominated(plan, capacity)
    best_fit(plan, capacity)
    return plan


def _locate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, keys = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            _, first, _, sequence, each, offset = entries[at].T
            step = rank - first
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c != "rank"],
                    pa.array(sequence + step // each, pa.int64()),
                    pa.array(offset + step % each * length, pa.int64()),
                ],
                [*[c for c in batch.schema.names if c != "rank"], "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` (1 to capacity) and unique ``keys``, plus their sequence_id and offset.

    Rows that agree in all keys and the length may change places with each other. An empty table
    stays empty.
    """
    spark = prepare(pieces.sparkSession)
    numbered = pieces.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per length and part: at most capacity * PARTS rows, whatever the table.
    sizes = staged(
        numbered.groupBy("length", "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))),
        "lengths",
    )
    # One row per length: at most ``capacity`` rows.
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = make_plan(histogram, capacity)
    entries = np.array(sorted(plan.entries), np.int64).reshape(-1, 6)
    # The plan's size is bounded by the capacity: a sequence holds few different lengths, and each
    # length adds few runs of sequences. It does not grow with the documents.
    shared = spark.sparkContext.broadcast((entries, (entries[:, 0] << 48) | entries[:, 1]))
    inside = W.partitionBy("length", "_part").orderBy(*keys)
    ranked = (
        numbered.withColumn("_inner", F.row_number().over(inside) - 1)
        .join(sizes.select("length", "_part", "_before"), ["length", "_part"])
        .select(*pieces.columns, (F.col("_before") + F.col("_inner")).alias("rank"))
    )
    schema = [f"`{c}` {t}" for c, t in pieces.dtypes]
    return ranked.mapInArrow(
        _locate(shared), ", ".join([*schema, "sequence_id bigint", "offset bigint"])
    )
