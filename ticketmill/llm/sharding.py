"""Shards of nearly equal bytes: a minimax contiguous partition of ordered groups.

Rows with equal text are one group that stays whole. Groups are ordered by the SHA-256 of their
text, and a shard is a run of groups. The smallest capacity with which all groups fit is found by
binary search: a greedy pass fills each shard as far as the capacity allows and counts the shards.

The passes need no row. Groups are summed by a prefix of their digest, which gives a few thousand
cells in order. A capacity for which cells fit whole is surely feasible; one for which they do not
fit even if cells could be cut anywhere surely is not. Only the cells in which a cut may lie between
these two bounds are summed again by a longer prefix, until such cells are single groups and the
bounds meet. What reaches the driver is bounded by the number of shards and not by the rows.

Everything on rows is a DataFrame expression.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, staged

SHARDS = 24
#: Bytes that a row adds to its text.
ROW_BYTES = 8
#: Hexadecimal digits of the first prefix, and by how many it grows.
FIRST_DIGITS, MORE_DIGITS = 3, 1
#: Parts in which a shard's rows are numbered, so that no shard is one task.
PARTS = 4096


@dataclass(frozen=True)
class Cell:
    """Neighbouring groups: their digests start with ``prefix``; ``single`` is one group alone."""

    prefix: str
    size: int
    largest: int
    single: bool


class Cells:
    def __init__(self, cells: list[Cell]):
        self.cells = sorted(cells, key=lambda c: c.prefix)
        self.sums = [0, *accumulate(c.size for c in self.cells)]
        self.total = self.sums[-1]

    def whole_end(self, start: int, capacity: int) -> int:
        """Index of the cell behind the longest run of whole cells from ``start`` that fits."""
        return bisect_right(self.sums, self.sums[start] + capacity) - 1

    def whole_cuts(self, capacity: int) -> list[int]:
        """Ends of greedy shards made of whole cells; stops early if a cell does not fit."""
        ends, at = [], 0
        while at < len(self.cells):
            end = self.whole_end(at, capacity)
            if end == at:
                return []
            ends.append(end)
            at = end
        return ends

    def loose_cuts(self, capacity: int) -> list[int]:
        """Greedy ends in bytes if a cell of several groups could be cut anywhere."""
        ends, at = [], 0
        while at < self.total:
            end = min(at + capacity, self.total)
            i = bisect_right(self.sums, end) - 1
            if i < len(self.cells) and self.cells[i].single:
                end = self.sums[i]
            if end <= at:
                return []
            ends.append(end)
            at = end
        return ends

    def fits(self, cuts: list[int], shards: int) -> bool:
        return not self.cells or 0 < len(cuts) <= shards

    def smallest(self, cuts, shards: int, low: int) -> int:
        """The smallest capacity from ``low`` on with which the greedy pass needs no more shards."""
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.fits(cuts(middle), shards):
                high = middle
            else:
                low = middle + 1
        return low


def _summed(groups: DataFrame, digits: int) -> list[Cell]:
    """Cells of all groups by a prefix of their digest; bounded by what ``groups`` was cut down to."""
    prefix = F.substring("digest", 1, digits).alias("prefix")
    rows = (
        groups.groupBy(prefix)
        .agg(
            F.sum("size").alias("size"),
            F.max("size").alias("largest"),
            (F.count("*") == 1).alias("single"),
        )
        .collect()
    )
    return [Cell(r.prefix, r["size"], r.largest, r.single) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """(smallest capacity, first digest of every shard but the first) for (digest, size) groups."""
    cells = Cells(_summed(groups, FIRST_DIGITS))
    digits = FIRST_DIGITS
    while True:
        largest = max((c.largest for c in cells.cells), default=0)
        low = cells.smallest(cells.loose_cuts, shards, max(largest, -(-cells.total // shards)))
        high = cells.smallest(cells.whole_cuts, shards, low)
        if low == high:
            break
        # The j-th cut of any capacity between the bounds lies between the j-th cuts of the bounds.
        finest = [bisect_right(cells.sums, x) - 1 for x in cells.loose_cuts(low)]
        widest = [bisect_right(cells.sums, x) - 1 for x in cells.loose_cuts(high)]
        open_ = {
            i
            for a, b in zip(finest, widest + [len(cells.cells)] * len(finest))
            for i in range(max(a - 1, 0), min(b + 1, len(cells.cells)))
            if not cells.cells[i].single
        }
        if not open_:
            break
        digits += MORE_DIGITS
        longer = {cells.cells[i].prefix for i in open_}
        by_length: dict[int, list[str]] = {}
        for p in longer:
            by_length.setdefault(len(p), []).append(p)
        inside = F.lit(False)
        for n, prefixes in by_length.items():
            inside = inside | F.substring("digest", 1, n).isin(prefixes)
        kept = [c for i, c in enumerate(cells.cells) if i not in open_]
        cells = Cells(kept + _summed(groups.filter(inside), digits))
    return high, [cells.cells[i].prefix for i in _even_cuts(cells, high, shards)]


def _even_cuts(cells: Cells, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near to an even share of what is left as it may be.

    The greedy pass from the left gives the latest place of every cut, the one from the right the
    earliest. Where a hot group sets the capacity, this keeps the other shards even.
    """
    n = len(cells.cells)
    latest = cells.whole_cuts(capacity)
    latest += [n] * (shards - len(latest))
    earliest, at = [n], n
    for _ in range(shards - 1):
        at = next(i for i in _from(cells.sums, cells.sums[at] - capacity) if i <= at)
        earliest.append(at)
    earliest = earliest[::-1]  # of the ends of shards 0 .. shards - 1
    if cells.sums[earliest[0]] > capacity:
        return [i for i in latest[:-1] if i < n]
    cuts, start = [], 0
    for j in range(shards - 1):
        share = cells.sums[start] + (cells.total - cells.sums[start]) / (shards - j)
        # While there are cells, no shard stays empty.
        first = max(earliest[j], min(start + 1, n))
        last = max(first, min(latest[j], cells.whole_end(start, capacity)))
        i = min(max(bisect_right(cells.sums, share) - 1, first), last)
        if i < last and cells.sums[i + 1] - share < share - cells.sums[i]:
            i += 1
        cuts.append(i)
        start = i
    return [i for i in cuts if i < n]


def _from(sums: list[int], least: int):
    """Indices of sums from the first that is at least ``least``."""
    i = bisect_right(sums, least - 1)
    return range(i, len(sums))


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; rows with equal text share a shard.

    The size is the text's UTF-8 bytes and ``ROW_BYTES``. Null texts are one group, empty texts
    another. The largest shard is as small as whole groups in this order allow; with fewer groups
    than shards, some shards stay empty. Slots count a shard's rows from 0 without gaps; repeated
    rows get slots of their own. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    body = F.col(text)
    rows = staged(
        docs.select(
            F.col(id_column).alias("id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.coalesce(F.sha2(body, 256), F.lit("")).alias("digest"),
        ),
        "sized",
    )
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    placed = rows.select(
        "id", "size", "text_crc32", _shard_of(F.col("digest"), cuts).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("_part"),
    )
    return _slotted(staged(placed, "placed")).withColumnRenamed("id", id_column)


def _shard_of(digest: Column, cuts: list[str]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (digest >= cut).cast("int")
    return shard


def _slotted(placed: DataFrame) -> DataFrame:
    """Gapless slots: numbers inside each part of a shard, plus the rows of the parts before."""
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_part")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("shard", "_part").orderBy("id", "text_crc32", "size")
    return (
        placed.withColumn("_inner", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_part"])
        .select(
            "id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_inner")).alias("slot")
        )
    )
