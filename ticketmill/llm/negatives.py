"""Hard negatives: rotated one-bit codes, interval filter, whole-number scores.

Vectors become whole numbers. Every row is turned by one random rotation and written down as a few sign
codes: the signs of the turned vector, then of what is left of it, and so on; beside each code stands its
alignment, the inner product of the vector with the code's unit vector, and at the end the length of the
rest. An anchor is turned as well and cut into bit planes, so its product with a code is a sum of
popcounts. By Cauchy and Schwarz the true product lies within |anchor| * |rest| plus |lost bits| *
|coded part| of that estimate, always. Only rows whose interval reaches the best known so far (and the
wanted band of scores) are scored, by whole numbers, so the result is exact.

Rows lie in shards sorted by label, anchors in stripes; a stripe meets the shards that hold its labels
for the positives and all shards for the negatives, each pair in one step of a task. Only the best few
of a pair leave it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.taskcontext import TaskContext

from .common import prepare, staged

#: Bytes of a shard's and a stripe's vectors, as 8-byte components.
SHARD_BYTES = 2 << 20
STRIPE_BYTES = 1 << 20
#: Sign codes a vector, bit planes of an anchor.
CODES = 4
PLANES = 6
#: Anchors and rows that are estimated at a time.
ANCHORS, ROWS = 128, 2048
#: Rows of the best estimates that are scored first, to know what the others must reach.
FIRST = 24
#: Copies of a block that one task sends out at most, and pairs of blocks in a task at most.
COPIES, PAIRS = 256, 64
#: What rounding may add to an interval, as a share of the lengths.
SLACK = 1e-9


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """One random rotation for every dimension, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(12).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def encode(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, lengths of the rest) of rows of whole numbers."""
    rest = whole.astype(float) @ rotation(whole.shape[1])
    codes, aligned = [], []
    root = np.sqrt(whole.shape[1])
    for _ in range(CODES):
        bits = rest >= 0
        signs = np.where(bits, 1.0, -1.0)
        along = (rest * signs).sum(axis=1) / root
        rest -= along[:, None] * signs / root
        codes.append(packed(bits))
        aligned.append(along)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors ready to be held against codes."""

    def __init__(self, whole: np.ndarray):
        self.dim = whole.shape[1]
        turned = whole.astype(float) @ rotation(self.dim)
        self.length = np.linalg.norm(turned, axis=1)
        self.low = turned.min(axis=1)
        top = (1 << PLANES) - 1
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-300)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        kept = self.low[:, None] + level * self.step[:, None]
        self.lost = np.linalg.norm(turned - kept, axis=1)
        self.sums = kept.sum(axis=1)
        self.planes = [packed((level >> b) & 1) for b in range(PLANES)]

    def estimates(self, rows: slice, codes: np.ndarray, aligned: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Products of some anchors with the coded parts of some rows."""
        shape = (rows.stop - rows.start, len(codes))
        out, root = np.zeros(shape), np.sqrt(self.dim)
        kind = np.uint16 if self.dim << PLANES < 1 << 16 else np.uint32
        for c in range(codes.shape[1]):
            total = np.zeros(shape, kind)
            for b, plane in enumerate(self.planes):
                for w in range(codes.shape[2]):
                    both = np.bitwise_count(plane[rows, w][:, None] & codes[None, :, c, w])
                    total += np.left_shift(both, kind(b), dtype=kind)
            part = (2 * self.step[rows, None]) * total
            part += 2 * self.low[rows, None] * ones[None, :, c]
            part -= self.sums[rows, None]
            part *= aligned[None, :, c] / root
            out += part
        return out


class Best:
    """The best rows of every slot so far: larger scores first, ties to smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.worst = k, np.full(slots, -np.inf)
        self.slot = self.id = self.score = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = (
            np.concatenate(x) for x in ((self.slot, slot), (self.id, ids), (self.score, score))
        )
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        counts = np.diff(first, append=len(slot))
        kept = np.arange(len(slot)) - np.repeat(first, counts) < self.k
        self.slot, self.id, self.score = slot[kept], ids[kept], score[kept]
        full = counts >= self.k
        # A little less, so that rounding a large score never hides an equal one.
        last = score[first[full] + self.k - 1].astype(float)
        self.worst[slot[first[full]]] = np.nextafter(last, -np.inf)


class Block:
    """A stripe of anchors against a shard of rows."""

    def __init__(self, stripe: dict, shard: dict):
        self.a_ids, self.ids = stripe["ids"], shard["ids"]
        self.a_whole, self.whole = stripe["whole"], shard["whole"]
        names = {x: i for i, x in enumerate(shard["labels"])}
        known = np.array([names.get(x, -1) for x in stripe["labels"]], np.int64)
        self.a_label, self.label = known[stripe["label"]], shard["label"]
        self.anchors = Anchors(self.a_whole)
        self.codes, self.aligned, self.rest = shard["codes"], shard["aligned"], shard["rest"]
        dim = self.whole.shape[1]
        self.ones = np.bitwise_count(self.codes).sum(axis=2)
        coded = [
            2.0 * np.unpackbits(np.ascontiguousarray(self.codes[:, c]).view(np.uint8), axis=1, bitorder="little")[:, :dim] - 1
            for c in range(self.codes.shape[1])
        ]
        part = sum(x * self.aligned[:, c, None] for c, x in enumerate(coded)) / np.sqrt(dim)
        self.part = np.linalg.norm(part, axis=1)
        largest = float(np.abs(self.a_whole).max(initial=0)) * float(np.abs(self.whole).max(initial=0))
        # Sums below 2**53 are exact as doubles, and those are faster.
        self.kind = np.float64 if largest * dim < 2**53 else np.int64
        self.scored = 0

    def scores(self, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        self.scored += len(row)
        out = np.empty(len(row), np.int64)
        step = max(1, (8 << 20) // (8 * self.whole.shape[1]))
        for i in range(0, len(row), step):
            a, b = self.a_whole[anchor[i : i + step]], self.whole[row[i : i + step]]
            out[i : i + step] = np.einsum("ij,ij->i", a.astype(self.kind), b.astype(self.kind))
        return out

    def parts(self) -> Iterator[tuple]:
        """(anchors, rows, estimates, half widths) part by part."""
        for i in range(0, len(self.a_ids), ANCHORS):
            some = slice(i, min(i + ANCHORS, len(self.a_ids)))
            length, lost = self.anchors.length[some, None], self.anchors.lost[some, None]
            for j in range(0, len(self.ids), ROWS):
                rows = slice(j, min(j + ROWS, len(self.ids)))
                middle = self.anchors.estimates(
                    some, self.codes[rows], self.aligned[rows], self.ones[rows]
                )
                whole = self.part[rows] + self.rest[rows]
                half = length * (self.rest[rows] + SLACK * whole) + lost * self.part[rows] + SLACK
                yield some, rows, middle, half

    def positives(self, k: int) -> Best:
        """The best ``k`` other rows of an anchor's label; slots are anchors."""
        best = Best(len(self.a_ids), k)
        for some, rows, middle, half in self.parts():
            open_ = self.a_label[some, None] == self.label[None, rows]
            open_ &= self.a_ids[some, None] != self.ids[None, rows]
            for first in (True, False):
                if first:
                    take = _leading(np.where(open_, middle, -np.inf), best.worst[some] == -np.inf)
                else:
                    take = open_ & (middle + half >= best.worst[some, None])
                open_ &= ~take
                a, r = np.nonzero(take)
                a, r = a + some.start, r + rows.start
                best.add(a, self.ids[r], self.scores(a, r))
        return best

    def negatives(self, low: np.ndarray, high: np.ndarray, k: int) -> Best:
        """The best ``k`` rows of other labels with scores in a band; ``low`` and ``high`` are
        matrices of anchors by bands, slot = anchor * bands + band."""
        bands = low.shape[1]
        best = Best(len(self.a_ids) * bands, k)
        for some, rows, middle, half in self.parts():
            open_ = self.a_label[some, None] != self.label[None, rows]
            for first in (True, False):
                worst = best.worst.reshape(-1, bands)[some]
                take = np.zeros_like(open_)
                for b in range(bands):
                    lo, hi = low[some, b, None], high[some, b, None]
                    if first:
                        inside = np.where(open_ & (middle <= hi), middle, -np.inf)
                        take |= _leading(inside, worst[:, b] == -np.inf)
                    else:
                        least = np.maximum(lo, worst[:, b, None])
                        take |= (middle + half >= least) & (middle - half <= hi)
                take &= open_
                open_ &= ~take
                a, r = np.nonzero(take)
                a, r = a + some.start, r + rows.start
                score = self.scores(a, r)
                worst = best.worst.reshape(-1, bands)
                slots, ids, scores = [], [], []
                for b in range(bands):
                    inside = (score >= low[a, b]) & (score <= high[a, b]) & (score >= worst[a, b])
                    slots.append(a[inside] * bands + b)
                    ids.append(self.ids[r[inside]])
                    scores.append(score[inside])
                best.add(np.concatenate(slots), np.concatenate(ids), np.concatenate(scores))
        return best


def _leading(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ``FIRST`` largest finite values of the wanted rows."""
    out = np.zeros(values.shape, bool)
    at = np.flatnonzero(wanted)
    if not len(at):
        return out
    if values.shape[1] <= FIRST:
        out[at] = True
    else:
        top = np.argpartition(-values[at], FIRST, axis=1)[:, :FIRST]
        out[at[:, None], top] = True
    return out & np.isfinite(values)


PACKED = """dim int, block long, labels array<string>, label binary, ids binary, wide int, whole binary,
    codes binary, aligned binary, rest binary"""


def _packed_blocks(most_bytes: int, coded: bool) -> Callable:
    """Sorted rows (dim, label, vec_id, whole) as blocks of bounded size, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            dims = rows.column("dim").to_numpy()
            at = 0
            while at < len(rows):
                end = int(np.searchsorted(dims, dims[at], "right"))
                most = max(16, most_bytes // (8 * int(dims[at])))
                if end == len(rows) and end - at < most:
                    break
                take = min(most, end - at)
                yield one(rows.slice(at, take), int(dims[at]), (task << 32) + number)
                at, number = at + take, number + 1
            rest = rows.slice(at)
        if rest is not None and len(rest):
            yield one(rest, rest.column("dim")[0].as_py(), (task << 32) + number)

    def one(rows: pa.Table, dim: int, number: int) -> pa.RecordBatch:
        label = pa.array(rows.column("label").to_pylist(), pa.string()).dictionary_encode()
        whole = rows.column("whole").combine_chunks().flatten().to_numpy().reshape(len(rows), dim)
        largest = int(np.abs(whole).max(initial=0))
        kind = np.dtype(np.int16 if largest < 1 << 15 else np.int32)
        parts = encode(whole) if coded else (np.zeros(0),) * 3
        ids = rows.column("vec_id").to_numpy()
        return pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim], pa.int32()),
                "block": pa.array([number], pa.int64()),
                "labels": pa.array([label.dictionary.to_pylist()], pa.list_(pa.string())),
                "label": [label.indices.to_numpy().astype(np.int32).tobytes()],
                "ids": [ids.astype(np.int64).tobytes()],
                "wide": pa.array([kind.itemsize], pa.int32()),
                "whole": [whole.astype(kind).tobytes()],
                "codes": [parts[0].tobytes()],
                "aligned": [parts[1].tobytes()],
                "rest": [parts[2].tobytes()],
            }
        )

    return pack


def _unpacked(row: dict, prefix: str, coded: bool) -> dict:
    dim = row["dim"]
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    kind = {2: np.int16, 4: np.int32}[row[f"{prefix}wide"]]
    out = {
        "ids": ids,
        "labels": row[f"{prefix}labels"],
        "label": np.frombuffer(row[f"{prefix}label"], np.int32),
        "whole": np.frombuffer(row[f"{prefix}whole"], kind).reshape(len(ids), dim).astype(np.int64),
    }
    if coded:
        out["codes"] = np.frombuffer(row[f"{prefix}codes"], np.uint64).reshape(len(ids), CODES, -1)
        out["aligned"] = np.frombuffer(row[f"{prefix}aligned"]).reshape(len(ids), CODES)
        out["rest"] = np.frombuffer(row[f"{prefix}rest"])
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(_unpacked(row, "a_", False), _unpacked(row, "", True))


POSITIVES = "stripe long, anchor int, anchor_id long, positive_id long, positive_score long"


def _positives(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks_of(batches):
            best = block.positives(k)
            yield pa.RecordBatch.from_pydict(
                {
                    "stripe": np.full(len(best.slot), row["a_block"]),
                    "anchor": best.slot.astype(np.int32),
                    "anchor_id": block.a_ids[best.slot],
                    "positive_id": best.id.astype(np.int64),
                    "positive_score": best.score.astype(np.int64),
                }
            )

    return run


NEGATIVES = """stripe long, anchor int, place int, anchor_id long, positive_id long, negative_id long,
    positive_score long, negative_score long"""


def _negatives(positives: int, k: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks_of(batches):
            # Bands of places without a positive are empty.
            lows = np.full((len(block.a_ids), positives), np.iinfo(np.int64).max)
            highs, scores, ids = -lows, np.zeros_like(lows), np.zeros_like(lows)
            for p in row["bands"]:
                i, j, score = p["anchor"], p["place"] - 1, p["positive_score"]
                # 100 * negative between low * positive and high * positive, in whole numbers.
                lows[i, j], highs[i, j] = -((-low * score) // 100), (high * score) // 100
                scores[i, j], ids[i, j] = score, p["positive_id"]
            best = block.negatives(lows, highs, k)
            anchor, place = np.divmod(best.slot, positives)
            yield pa.RecordBatch.from_pydict(
                {
                    "stripe": np.full(len(anchor), row["a_block"]),
                    "anchor": anchor.astype(np.int32),
                    "place": (place + 1).astype(np.int32),
                    "anchor_id": block.a_ids[anchor],
                    "positive_id": ids[anchor, place],
                    "negative_id": best.id.astype(np.int64),
                    "positive_score": scores[anchor, place],
                    "negative_score": best.score.astype(np.int64),
                }
            )

    return run


def _whole(vectors: DataFrame, anchors: Column, id_column: str, label: str, vector: str, scale: int):
    """Usable rows: dim, label, vec_id, anchor, whole numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(1 << 31)))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    rows = vectors.filter(
        F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False))
    ).select(
        F.size(vector).alias("dim"),
        F.col(label).cast("string").alias("label"),
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        whole.alias("whole"),
    )
    # By Cauchy and Schwarz no score and no part of its sum leaves a long.
    square = F.aggregate("whole", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    return rows.filter((square < 4e18) & (F.col("dim") > 0))


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30,
    high: int = 90, scale: int = 256, id_column: str = "vec_id", label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells which rows ask. A component x counts as floor(scale * x); a score is the inner
    product of two rows. The positives of an anchor are the best rows of its label with another id, as
    many as ``positives``; for each of them the result has the best ``negatives`` rows of other labels
    whose score is between ``low`` and ``high`` percent of the positive's, ranks from 1. Ties go to the
    smaller id. Fewer rows, fewer results; a positive whose band is empty, or negative as its score, has
    none.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, a component of
    2**31 / scale or more, or a squared length of 4e18 or more take no part. Vectors meet only those of
    their own length. Rows that share an id each count on their own, also as anchors, but are never
    positives of one another. Other columns are not looked at.
    """
    prepare(vectors.sparkSession)
    rows = _whole(vectors, anchors, id_column, label, vector, scale)
    order = ["dim", "label", "_h", "vec_id"]

    def blocks(of: DataFrame, most_bytes: int, coded: bool, name: str) -> DataFrame:
        placed = of.withColumn("_h", F.xxhash64("vec_id", "whole")).drop("anchor")
        dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        found = dealt.select("dim", "label", "vec_id", "whole").mapInArrow(
            _packed_blocks(most_bytes, coded), PACKED
        )
        return staged(found, name)

    shards = blocks(rows, SHARD_BYTES, True, "shards")
    stripes = blocks(rows.filter("anchor"), STRIPE_BYTES, False, "stripes")
    stripes = stripes.select(
        "dim", *[F.col(c).alias(f"a_{c}") for c in ("block", "labels", "label", "ids", "wide", "whole")]
    )
    n_shards, n_stripes = shards.count(), stripes.count()

    def sent(pairs: DataFrame, side: DataFrame, key: str, other: str, others: int) -> DataFrame:
        """A block to each of its pairs; a block of many pairs is sent out by several tasks."""
        by = max(1, -(-others // COPIES))
        salt = F.pmod(F.xxhash64(other), F.lit(by)).cast("int")
        copies = side.withColumn("_by", F.explode(F.sequence(F.lit(0), F.lit(by - 1))))
        return pairs.withColumn("_by", salt).join(copies, ["dim", key, "_by"]).drop("_by")

    def met(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """Pairs of blocks with both sides' rows, every pair in a place of its own."""
        pairs = staged(pairs, "pairs")
        n = pairs.count()
        width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(n, max(width, n // PAIRS)))
        key = ["dim", "block", "a_block"]
        left = sent(pairs, shards, "block", "a_block", n_stripes).repartition(tasks, *key)
        right = sent(pairs, asking, "a_block", "block", n_shards).repartition(tasks, *key)
        return left.join(right, key)

    # Pairs of blocks are pairs of numbers first.
    mine = shards.select("dim", "block", F.explode("labels").alias("of"))
    theirs = stripes.select("dim", "a_block", F.explode("a_labels").alias("of"))
    same = mine.join(theirs, ["dim", "of"]).select("dim", "block", "a_block").distinct()
    partial = met(same, stripes).mapInArrow(_positives(positives), POSITIVES)
    own = W.partitionBy("stripe", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = staged(
        partial.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= positives),
        "positives",
    )
    # A stripe's positives are as many as its anchors times ``positives`` at most.
    bands = chosen.groupBy(F.col("stripe").alias("a_block")).agg(
        F.collect_list(F.struct("anchor", "place", "positive_id", "positive_score")).alias("bands")
    )
    asked = stripes.join(bands, "a_block")
    # Every stripe meets every shard.
    every = shards.select("dim", "block").join(stripes.select("dim", "a_block"), "dim")
    partial = met(every, asked).mapInArrow(_negatives(positives, negatives, low, high), NEGATIVES)
    own = W.partitionBy("stripe", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        partial.withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
