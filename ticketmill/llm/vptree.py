"""Nearest neighbours by inner product: a vantage-point tree per shard of vectors.

The largest inner product is the smallest distance once every vector gets one more component that
brings all of them to the same norm; distances obey the triangle inequality, so a subtree can be
passed over when no point of it can be among the best. ``factor`` relaxes that test: a subtree is
passed over when its bound exceeds ``factor`` times the distance of the worst result so far. Factor
one loses nothing; smaller factors visit less.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows and queries to blocks of about
``BLOCK_ROWS``, and every shard meets every block in a task of its own. Only the best ``k`` of a
shard leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, staged
from .vectors import as_matrix, usable

SHARD_ROWS = 8192
BLOCK_ROWS = 8192
LEAF_ROWS = 256
#: Rounding that a distance may carry; it keeps exact ties reachable.
SLACK = 1e-7


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, added up in the order of the components.

    Every pair is computed alike wherever it stands, so equal vectors have equal products and ties
    are real; matrix products do not promise that.
    """
    out = np.zeros((len(a), len(b)))
    work = np.empty_like(out)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        np.multiply(x[:, None], y[None, :], out=work)
        out += work
    return out


@dataclass
class Node:
    """A leaf has rows; an inner node a vantage point, the median distance and two halves."""

    rows: np.ndarray
    vantage: int = -1
    middle: float = 0.0
    near: Node | None = None
    far: Node | None = None


class Tree:
    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS, seed: int = 3):
        self.ids, self.points = ids, points
        norms = (points**2).sum(axis=1)
        self.square = float(norms.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.square - norms, 0))
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows)
        vantage = int(self.rng.choice(rows))
        inner = self.points[rows] @ self.points[vantage] + self.extra[rows] * self.extra[vantage]
        distance = np.sqrt(np.maximum(2 * self.square - 2 * inner, 0))
        middle = float(np.median(distance))
        near = distance <= middle
        if near.all():  # more than half of the points lie at one distance
            near = distance < middle
        if not near.any():
            return Node(rows)
        return Node(rows, vantage, middle, self._build(rows[near]), self._build(rows[~near]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0):
        """(query row, id, product) of the best ``k`` per query, ties to smaller ids."""
        self.query_ids, self.queries, self.k, self.factor = query_ids, queries, k, factor
        self.norms = (queries**2).sum(axis=1)
        self.worst = np.full(len(queries), -np.inf)  # product of the k-th best so far
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self._visit(self.root, np.arange(len(queries)))
        return self.found

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.near is None:
            # Leaves that could not be halved may be large.
            for part in np.array_split(node.rows, -(-len(node.rows) // self.leaf) or 1):
                self._scan(part, rows)
            return
        inner = self.queries[rows] @ self.points[node.vantage]
        distance = np.sqrt(np.maximum(self.norms[rows] + self.square - 2 * inner, 0))
        gap = distance - node.middle
        inside = gap <= 0
        self._visit(node.near, rows[inside])
        self._visit(node.far, rows[~inside])
        reach = np.sqrt(np.maximum(self.norms[rows] + self.square - 2 * self.worst[rows], 0))
        open_ = np.abs(gap) <= self.factor * reach + SLACK
        self._visit(node.far, rows[inside & open_])
        self._visit(node.near, rows[~inside & open_])

    def _scan(self, points: np.ndarray, rows: np.ndarray) -> None:
        score = products(self.queries[rows], self.points[points])
        better = score >= self.worst[rows][:, None]
        better &= self.ids[points][None, :] != self.query_ids[rows][:, None]
        at, of = np.nonzero(better)
        if not len(at):
            return
        touched = np.unique(rows[at])
        mark = np.zeros(len(self.queries), bool)
        mark[touched] = True
        old = mark[self.found[0]]
        row = np.concatenate([self.found[0][old], rows[at]])
        ids = np.concatenate([self.found[1][old], self.ids[points][of]])
        values = np.concatenate([self.found[2][old], score[at, of]])
        order = np.lexsort((ids, -values, row))
        row, ids, values = row[order], ids[order], values[order]
        first = np.searchsorted(row, touched)
        counts = np.diff(np.append(first, len(row)))
        place = np.arange(len(row)) - np.repeat(first, counts)
        keep = place < self.k
        full = counts >= self.k
        self.worst[touched[full]] = values[first[full] + self.k - 1]
        self.found = tuple(
            np.concatenate([kept[~old], new[keep]])
            for kept, new in zip(self.found, (row, ids, values))
        )


def _searched(k: int, factor: float):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not len(queries) or not len(points):
            return _results(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids = points.column("vec_id").to_numpy()
        tree = Tree(ids, as_matrix(points.column("embedding")))
        asked = queries.column("vec_id").to_numpy()
        number = queries.column("query_key").to_numpy()
        row, found, score = tree.search(asked, as_matrix(queries.column("embedding")), k, factor)
        return _results(number[row], asked[row], found, score)

    return run


def _results(key, query, found, score) -> pa.Table:
    return pa.table({"query_key": key, "query_id": query, "vec_id": found, "score": score})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of ``vectors`` for every row of ``queries``.

    Both have ``id_column`` and ``vector``. A row is never a result of a query with the same id.
    Rows without an id or a usable vector take no part, rows that agree in id and vector count once,
    and vectors are compared with those of their own length only. Ties go to the smaller id. A query
    has fewer results if there are fewer other vectors, and none if there are none.
    """
    prepare(vectors.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"))
        kept = usable(kept).withColumn("query_key", F.xxhash64("vec_id", "embedding"))
        return kept.groupBy("vec_id", "query_key", "dim").agg(F.first("embedding").alias("embedding"))

    points, asked = staged(rows(vectors), "points"), staged(rows(queries), "asked")
    # One row per vector length; usually there is one.
    sizes = (
        points.groupBy("dim")
        .agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
        .join(
            asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")),
            "dim",
        )
    )

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(n: str, salt: int):
        return F.pmod(F.xxhash64("vec_id", "query_key", F.lit(salt)), F.col(n)).cast("int")

    sharded = points.join(sizes, "dim").withColumn("shard", dealt("shards", 1))
    sharded = sharded.select("dim", "shard", numbers("blocks").alias("block"), "vec_id", "embedding")
    blocks = asked.join(sizes, "dim").withColumn("block", dealt("blocks", 2))
    blocks = blocks.select(
        "dim", numbers("shards").alias("shard"), "block", "vec_id", "embedding", "query_key"
    )
    key = ["dim", "shard", "block"]
    best = (
        blocks.groupBy(*key)
        .cogroup(sharded.groupBy(*key))
        .applyInArrow(
            _searched(k, factor), "query_key bigint, query_id bigint, vec_id bigint, score double"
        )
    )
    order = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
