"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word becomes the counts of its letters. One inserted, deleted or replaced letter changes them by two
in all at most, so the words near a word lie in a small box around its counts. For every length there is
one k-d tree over the words of that length; words of the length ask for points with one letter more and
one less, words longer by one for points with one letter less. Branches whose box is out of reach are
pruned; what is met in a leaf is compared by counts, then by the order of letters.

The top of a large tree is grown on the driver from a bounded sample and splits its length into cells.
A word is a point in its own cell and asks in all cells its box touches; every cell is a task's group,
where the rest of the tree is grown over all its points. Cells that are still too large (words of
the same letters) are cut once more: two words one edit apart agree in their first or in their last
half, so each word goes to a group by either half.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged
from .memory import ramp

#: Words a cell should hold, cells at most, and words that the tops of trees are grown on at most.
CELL_WORDS = 8192
MOST_CELLS = 8192
SAMPLE_WORDS = 1 << 17
#: Rows of a cell (points and words that ask) beyond which it is cut by halves.
CELL_ROWS = 1 << 16
LEAF_WORDS = 128
#: Letters a to z have a place each, all others share these.
OTHERS = 6
PLACES = 26 + OTHERS
#: Numbers that a step of a search holds at a time.
STEP = 4 << 20


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, where each word begins)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def counts_of(words: list[str]) -> np.ndarray:
    """Letter counts, a row per word."""
    points, at = letters_of(words)
    own = (points >= 97) & (points <= 122)
    place = np.where(own, points - np.uint32(97), np.uint32(26) + points % np.uint32(OTHERS))
    row = np.repeat(np.arange(len(words)), np.diff(at))
    flat = np.bincount(row * PLACES + place, minlength=len(words) * PLACES)
    return flat.reshape(len(words), PLACES).astype(np.int32)


@dataclass
class Tree:
    """Nodes in flat arrays; a leaf has place -1 and its number as ``cut``."""

    place: list[int]
    cut: list[int]
    right: list[int]
    leaves: int = 0

    def _add(self, place: int, cut: int) -> int:
        self.place.append(place)
        self.cut.append(cut)
        self.right.append(0)
        return len(self.place) - 1


def grow(points: np.ndarray, leaf: int, most: int = 1 << 30) -> Tree:
    """A tree over rows of counts: the widest place is cut in the middle until ``leaf`` rows are left."""
    tree = Tree([], [], [])
    stack = [(np.arange(len(points)), -1, most)]
    while stack:
        rows, parent, room = stack.pop()
        at = tree._add(-1, 0)
        if parent >= 0:
            tree.right[parent] = at
        found = None
        if len(rows) > leaf and room > 1:
            own = points[rows]
            for place in np.argsort(-own.var(axis=0), kind="stable")[:4].tolist():
                values = np.sort(own[:, place])
                if values[0] == values[-1]:
                    break
                # The cut next to the middle that leaves something on either side.
                middle = values[(len(values) - 1) // 2]
                cuts = [middle, middle - 1] if middle < values[-1] else [values[values < middle][-1]]
                cuts = [c for c in cuts if values[0] <= c < values[-1]]
                sizes = [abs(2 * np.searchsorted(values, c, "right") - len(values)) for c in cuts]
                best = int(np.argmin(sizes))
                if found is None or sizes[best] < found[0]:
                    found = (sizes[best], place, int(cuts[best]))
        if found is None:
            tree.cut[at] = tree.leaves
            tree.leaves += 1
            continue
        _, tree.place[at], tree.cut[at] = found
        low = points[rows, found[1]] <= found[2]
        # The left child comes next in the arrays, so it goes on the stack last and without a parent.
        stack.append((rows[~low], at, room // 2))
        stack.append((rows[low], -1, room - room // 2))
    return tree


def home(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """The leaf in which each row of counts lies."""
    out = np.zeros(len(counts), np.int64)
    stack = [(0, np.arange(len(counts)))]
    while stack:
        at, rows = stack.pop()
        if not len(rows):
            continue
        if tree.place[at] < 0:
            out[rows] = tree.cut[at]
            continue
        low = counts[rows, tree.place[at]] <= tree.cut[at]
        stack += [(at + 1, rows[low]), (tree.right[at], rows[~low])]
    return out


def reached(tree: Tree, counts: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows whose box touches it): points may have ``more`` letters in one place more than the
    row has, and one less in one place."""
    nothing = np.zeros(len(counts), np.int32)
    stack = [(0, np.arange(len(counts)), nothing, nothing, {})]
    while stack:
        at, rows, up, down, box = stack.pop()
        if not len(rows):
            continue
        place, cut = tree.place[at], tree.cut[at]
        if place < 0:
            yield cut, rows
            continue
        own = counts[rows, place]
        low, high = box.get(place, (0, None))
        lower = down + np.maximum(own - cut, 0)
        if high is not None:
            lower -= np.maximum(own - high, 0)
        upper = up + np.maximum(cut + 1 - own, 0) - np.maximum(low - own, 0)
        left, right = lower <= 1, upper <= more
        stack.append((at + 1, rows[left], up[left], lower[left], {**box, place: (low, cut)}))
        stack.append((tree.right[at], rows[right], upper[right], down[right], {**box, place: (cut + 1, high)}))


def matrix_of(words: list[str], length: int) -> np.ndarray:
    points, _ = letters_of(words)
    kind = np.uint8 if not len(points) or points.max() < 256 else np.uint32
    return points.astype(kind).reshape(len(words), length)


class Cell:
    """The points of a cell (words of one length), and the words that ask there."""

    def __init__(self, length: int, points: list[str], side: str = ""):
        self.length, self.half, self.side = length, length // 2, side
        self.points = matrix_of(points, length)
        self.counts = counts_of(points)
        self.tree = grow(self.counts, LEAF_WORDS)
        leaf = home(self.tree, self.counts)
        order = np.argsort(leaf, kind="stable")
        edges = np.searchsorted(leaf[order], np.arange(self.tree.leaves + 1))
        self.members = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.compared = 0

    def near(self, asking: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word that asks, point) for all pairs one edit apart; ``longer`` words have one letter more."""
        letters = matrix_of(asking, self.length + longer)
        counts = counts_of(asking)
        # Sums of squares of counts are exact in single precision up to 2**24.
        kind = np.float32 if self.length < 2000 else np.float64
        mine, theirs = counts.astype(kind), self.counts.astype(kind)
        mine_2, theirs_2 = (mine**2).sum(axis=1), (theirs**2).sum(axis=1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for leaf, rows in reached(self.tree, counts, 0 if longer else 1):
            members = self.members[leaf]
            if len(members) > 8 * LEAF_WORDS:  # the same letters all over: only halves tell them apart
                found += self._by_halves(letters, rows, members, longer)
                continue
            step = max(1, STEP // max(len(members), 1))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                apart = mine_2[some, None] + theirs_2[None, members] - 2 * (mine[some] @ theirs[members].T)
                q, p = np.nonzero(apart <= (1.5 if longer else 2.5))
                found.append(self._kept(letters, some[q], members[p], longer))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _halves(self, letters: np.ndarray, first: bool) -> np.ndarray:
        part = letters[:, : self.half] if first else letters[:, letters.shape[1] - (self.length - self.half) :]
        part = np.ascontiguousarray(part.astype(np.uint32))
        return part.view(f"V{max(part.shape[1], 1) * 4}").ravel() if part.shape[1] else np.zeros(len(part), "V4")

    def _by_halves(self, letters: np.ndarray, rows: np.ndarray, members: np.ndarray, longer: bool):
        """Pairs of a leaf whose points all have the same counts, met by equal halves."""
        for first in (True, False):
            theirs, mine = self._halves(self.points[members], first), self._halves(letters[rows], first)
            _, code = np.unique(np.concatenate([theirs, mine]), return_inverse=True)
            theirs, mine = code[: len(members)], code[len(members) :]
            order = np.argsort(theirs, kind="stable")
            start = np.searchsorted(theirs[order], mine, "left")
            count = np.searchsorted(theirs[order], mine, "right") - start
            ends = np.cumsum(count)
            at = 0
            while at < len(rows):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
                q = np.repeat(np.arange(at, to), count[at:to])
                p = order[np.repeat(start[at:to], count[at:to]) + ramp(count[at:to])]
                q, p = rows[q], members[p]
                if not first:  # pairs with equal first halves have been seen
                    other = (letters[q, : self.half] != self.points[p, : self.half]).any(axis=1)
                    q, p = q[other], p[other]
                yield self._kept(letters, q, p, longer)
                at = to

    def _kept(self, letters: np.ndarray, q: np.ndarray, p: np.ndarray, longer: bool):
        """Of pairs with near counts those with the letters in order, one edit apart."""
        self.compared += len(q)
        n, out = self.length, np.zeros(len(q), bool)
        step = max(1, STEP // max(n, 1))
        for i in range(0, len(q), step):
            x, y = letters[q[i : i + step]], self.points[p[i : i + step]]
            if longer:
                head = np.logical_and.accumulate(x[:, :n] == y, axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
                fine = head + tail >= n
            else:
                fine = (x != y).sum(axis=1) == 1
            if self.side:
                same = (x[:, : self.half] == y[:, : self.half]).all(axis=1)
                if self.side == "p":
                    fine &= same
                else:
                    k = n - self.half
                    fine &= ~same & (x[:, x.shape[1] - k :] == y[:, n - k :]).all(axis=1)
            out[i : i + step] = fine
        return q[out], p[out]


#: Roles in a cell: a point that also asks, a word of the length that asks, a word longer by one.
POINT, SAME, LONGER = 0, 1, 2

GROUPED = "length int, cell int, side string, bucket int, role int, word string, n bigint"
FOUND = "word string, n_near bigint, best_n bigint, best string"


def _dealt(trees: dict[int, Tree], cut: dict[tuple[int, int], int]) -> Callable:
    """Words to the cells where they are points or ask; ``cut`` has the buckets of cells cut by halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                own = [words[i] for i in rows.tolist()]
                counts = counts_of(own)
                for length in (size, size - 1):
                    if length >= 0:
                        yield from placed(own, ns[rows], counts, length, size)

    def placed(words, ns, counts, length, size) -> Iterator[pa.RecordBatch]:
        tree = trees.get(length)
        if tree is None:
            visits = [(0, np.arange(len(words)))]
            homes = np.zeros(len(words), np.int64)
        else:
            visits = reached(tree, counts, 1 if size == length else 0)
            homes = home(tree, counts)
        for cell, rows in visits:
            role = np.full(len(rows), LONGER)
            if size == length:
                role = np.where(homes[rows] == cell, POINT, SAME)
            own = [words[i] for i in rows.tolist()]
            buckets = cut.get((length, cell), 0)
            half = length // 2
            for side in ("p", "s") if buckets else ("",):
                bucket = np.zeros(len(own), np.int64)
                if side:
                    parts = [w[:half] if side == "p" else w[len(w) - (length - half) :] for w in own]
                    bucket = _bucket(parts, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), length, np.int32)),
                        pa.array(np.full(len(own), cell, np.int32)),
                        pa.array([side] * len(own), pa.string()),
                        pa.array(bucket.astype(np.int32)),
                        pa.array(role.astype(np.int32)),
                        pa.array(own, pa.string()),
                        pa.array(ns[rows], pa.int64()),
                    ],
                    ["length", "cell", "side", "bucket", "role", "word", "n"],
                )

    return run


def _bucket(parts: list[str], buckets: int) -> np.ndarray:
    """A fixed hash of each part, modulo the number of buckets."""
    points, at = letters_of(parts)
    weights = (np.arange(max((len(p) for p in parts), default=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(
        0x9E3779B97F4A7C15
    )
    values = (points.astype(np.uint64) + np.uint64(1)) * weights[ramp(np.diff(at))]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    mixed = sums[at[1:]] - sums[at[:-1]]
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(buckets)


def _searched(group: pa.Table) -> pa.Table:
    """Per word of a cell: how many near words it has here, and the most frequent one."""
    length, side = group.column("length")[0].as_py(), group.column("side")[0].as_py()
    roles = group.column("role").to_numpy()
    words, ns = group.column("word").to_pylist(), group.column("n").to_numpy()
    points = np.flatnonzero(roles == POINT)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(points):
        cell = Cell(length, [words[i] for i in points.tolist()], side)
        for longer in (False, True):
            asking = np.flatnonzero(roles == LONGER if longer else roles != LONGER)
            if not len(asking):
                continue
            q, p = cell.near([words[i] for i in asking.tolist()], longer)
            q, p = asking[q], points[p]
            pairs.append((q, p))
            if longer:  # words of one length meet from both sides, these only here
                pairs.append((p, q))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    names = np.array([words[i] for i in b.tolist()], object)
    rank = np.unique(names, return_inverse=True)[1] if len(names) else np.zeros(0, np.int64)
    order = np.lexsort((rank, -ns[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pa.table(
        {
            "word": pa.array([words[i] for i in a[first].tolist()], pa.string()),
            "n_near": pa.array(np.diff(first, append=len(a)), pa.int64()),
            "best_n": pa.array(ns[b[first]], pa.int64()),
            "best": pa.array([words[i] for i in b[first].tolist()], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words, ``best`` the near word
    of the largest n, ties to the smallest in code-point order."""
    # One row per length of word.
    by_length = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    large = {size: n for size, n in by_length.items() if n > CELL_WORDS}
    total = sum(large.values())
    trees: dict[int, Tree] = {}
    if large:
        share = min(1.0, SAMPLE_WORDS / total)
        seen = F.pmod(F.xxhash64(F.lit(13), "word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        sample = words.filter(F.length("word").isin(list(large)) & seen).select("word").toPandas()["word"]
        lengths = sample.str.len()
        for size, n in large.items():
            cells = min(-(-n // CELL_WORDS), max(1, MOST_CELLS * n // total))
            own = counts_of(sample[lengths == size].tolist())
            if cells > 1 and len(own) > 1:
                trees[size] = grow(own, max(1, len(own) // cells), cells)
    words = words.select("word", "n")
    sized = words.mapInArrow(_dealt(trees, {}), GROUPED).groupBy("length", "cell").agg(F.count("*").alias("n"))
    # At most as many rows as there are cells.
    full = {(r.length, r.cell): -(-r.n // CELL_ROWS) * 2 for r in sized.filter(F.col("n") > CELL_ROWS).collect()}
    grouped = words.mapInArrow(_dealt(trees, full), GROUPED)
    found = grouped.groupBy("length", "cell", "side", "bucket").applyInArrow(_searched, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n")
    )


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of words (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code point. The form of a
    word is its near word of the largest n, ties to the smallest in code-point order, if that n is at
    least ``ratio`` times its own; the root is where forms lead in the end, the word itself without one.
    ``n_near`` counts near words.

    Rows that repeat a word add up; a null word gives no row, a null n counts 0; words may have any
    letters and any length, also none. Other columns are not looked at. No words, no rows.
    """
    prepare(words.sparkSession)
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants")
    counted = words.filter(F.col("word").isNotNull()).groupBy("word").agg(
        F.sum(F.coalesce("n", F.lit(0).cast("bigint"))).alias("n")
    )
    counted = staged(counted, "words")
    near = near_words(counted)
    # A word without occurrences has no form, and forms grow by the ratio, so chains are short.
    formed = (F.col("n") > 0) & (F.col("best_n") >= F.col("n") * ratio)
    joined = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    )
    joined = staged(joined, "near")
    roots = joined.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = joined.agg(F.max("n")).first()[0] or 1
    steps = math.log(max(most, 2), ratio) + 1
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        # Each round doubles the steps taken.
        roots = staged(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("_far", "root").alias("root"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def word_counts(docs: DataFrame, least_letters: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of the runs of Latin letters in whole texts (doc_id, text), A to Z in lower case.

    Of a run whose crc32 with its document's id is divisible by ``every``, the code point at that number
    modulo the length is left out: known misspellings to find again. Words of fewer than
    ``least_letters`` code points or ``least`` occurrences do not count. A null text has no words, a null
    id counts as empty text.
    """
    # A run shorter than a word can be only gets shorter, so it is not even taken out.
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_letters},}})"), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(runs).alias("run")).select(
        "doc_id", F.translate("run", upper, upper.lower()).alias("run")
    )
    hash_ = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    words = run.withColumn("h", hash_).select(
        F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")
    )
    return (
        words.filter(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
    )
