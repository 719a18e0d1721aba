"""Near-duplicate vectors through pivots: ordered nearest reference points and inverted lists.

1. Vectors that are equal (with the same label) collapse to one node with a count.
2. Reference points are drawn from the nodes by a hash of their content, about the square root of
   their number. A node is described by its ``NEAREST`` nearest pivots, in order.
3. The inverted lists are kept per label and pair of pivots: a node stands in the list of every pair
   among its first ``LISTED`` pivots. Two nodes meet where they share such a pair, and are verified
   if they share at least ``SHARED`` of their nearest pivots.
4. A list is cut into parts of about ``PART_ROWS`` nodes, and every two parts meet in a block. A
   block verifies its candidates by exact cosines and gives, per node, a number of links and an edge
   to the smallest node of its family inside the block. A pair that shares several lists counts in
   the first one only, so counts add up, and no row is ever made for a single pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neardup import connected_components
from .common import list_column, prepare, sorted_blocks, staged
from .vectors import as_matrix, usable

THRESHOLD = 0.98
NEAREST, LISTED, SHARED = 8, 6, 3
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
PART_ROWS = 256
#: The highest cosine of two pivots.
APART = 0.8


def choose_pivots(nodes: DataFrame) -> np.ndarray:
    """Reference points: at most MOST_PIVOTS vectors of a sample four times as large.

    The sample is taken by a hash of the components. Vectors close to one already chosen are passed
    over: pivots that lie together would be ordered by chance, and a large family would fill the
    sample with its members.
    """
    wanted = int(np.clip(np.sqrt(nodes.count()), LEAST_PIVOTS, MOST_PIVOTS))
    rows = nodes.orderBy(F.xxhash64("embedding"), "node").select("embedding").limit(4 * wanted).collect()
    width = max((len(r.embedding) for r in rows), default=1)
    out = np.zeros((wanted, width))
    n = 0
    for r in rows:
        v = np.zeros(width)
        v[: len(r.embedding)] = np.array(r.embedding) / np.linalg.norm(r.embedding)
        if n < wanted and (out[:n] @ v).max(initial=-1.0) < APART:
            out[n] = v
            n += 1
    return out[:n]


def _describe(shared):
    """Adds the nearest pivots of every vector and the lists it stands in.

    A vector of another length than the pivots is held against the components both have; only
    vectors of one length are ever compared, and for those this is the same description.
    """
    pairs = np.array(list(combinations(range(LISTED), 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            lists, offsets = batch.column("embedding"), None
            lengths = lists.value_lengths().to_numpy()
            near = np.zeros((len(batch), min(NEAREST, len(pivots))), np.int32)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = as_matrix(lists.take(pa.array(at)))[:, : pivots.shape[1]]
                close = -(x @ pivots[:, : x.shape[1]].T)
                near[at] = np.argsort(close, axis=1, kind="stable")[:, : near.shape[1]]
            own = pairs[(pairs < near.shape[1]).all(axis=1)]
            if len(own):
                low = np.minimum(near[:, own[:, 0]], near[:, own[:, 1]]).astype(np.int64)
                keys = low * MOST_PIVOTS + np.maximum(near[:, own[:, 0]], near[:, own[:, 1]])
            else:  # a single pivot: one list
                keys = np.zeros((len(batch), 1), np.int64)
            offsets = np.arange(len(batch) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    list_column(near.ravel(), offsets * near.shape[1], pa.int32()),
                    list_column(keys.ravel(), offsets * keys.shape[1], pa.int64()),
                ],
                [*batch.schema.names, "near", "keys"],
            )

    return run


def _families(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links, the first row of its family."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    """Links inside blocks: (node, links, root) per linked node of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches, ["label", "dim", "key", "part_a", "part_b"]):
            if len(block) < 2:
                continue
            key, same = block["key"][0].as_py(), block["part_a"][0].as_py() == block["part_b"][0].as_py()
            first = (block["part"].to_numpy() == block["part_a"][0].as_py())
            x = as_matrix(block["embedding"])
            near = as_matrix(block["near"])
            cosine = _cosines(x)
            linked = cosine >= threshold
            np.fill_diagonal(linked, False)
            if not same:  # pairs inside a part belong to that part's own block
                linked &= first[:, None] != first[None, :]
            if not linked.any():
                continue
            a, b = np.nonzero(linked)
            common = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
            good = common.sum(axis=1) >= min(SHARED, near.shape[1])
            good &= _first_list(near[a], near[b]) == key
            linked[a[~good], b[~good]] = False
            counts = block["copies"].to_numpy()
            links = linked @ counts
            some = np.flatnonzero(links > 0)
            if len(some):
                names = block["node"].combine_chunks()
                root = _families(linked)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(some)).cast(pa.binary()),
                        pa.array(links[some].astype(np.int64)),
                        names.take(pa.array(root[some])).cast(pa.binary()),
                    ],
                    ["node", "links", "root"],
                )

    return run


def _first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest list that both of a pair stand in."""
    width = min(LISTED, a.shape[1])
    if width < 2:
        return np.zeros(len(a), np.int64)
    none = np.int64(MOST_PIVOTS)
    same = (a[:, :width, None] == b[:, None, :width]).any(axis=2)
    both = np.sort(np.where(same, a[:, :width], none), axis=1).astype(np.int64)
    return both[:, 0] * MOST_PIVOTS + both[:, 1]


def _cosines(x: np.ndarray) -> np.ndarray:
    """Cosines of all rows in double precision; equal rows give equal values."""
    inner = x @ x.T
    norms = np.sqrt((x**2).sum(axis=1))
    return inner / (norms[:, None] * norms[None, :])


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD,
    id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors are compared if their labels are equal and not null and they have the same length; they
    link from a cosine of ``threshold`` on. Vectors that are null, zero or hold null or non-finite
    components link with nothing. Repeated rows link with each other like any copies. A row without
    an id gives a row and counts as a link of others, but names no component. An empty table gives
    no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("embedding"),
    )
    taking_part = usable(rows.withColumn("row", F.lit(0)), "row").filter("label IS NOT NULL")
    content = F.to_binary(
        F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), ",")), 256),
        F.lit("hex"),
    )
    keyed = staged(taking_part.withColumn("node", content).drop("row"), "keyed")
    nodes = staged(
        keyed.groupBy("node").agg(
            F.first("label").alias("label"),
            F.first("dim").alias("dim"),
            F.first("embedding").alias("embedding"),
            F.min("vec_id").alias("head"),
            F.count("*").alias("copies"),
        ),
        "nodes",
    )
    shared = spark.sparkContext.broadcast(choose_pivots(nodes))  # MOST_PIVOTS rows at most
    described = nodes.select("node", "label", "dim", "copies", "embedding")
    fields = ", ".join(f"`{c}` {t}" for c, t in described.dtypes)
    described = staged(
        described.mapInArrow(_describe(shared), f"{fields}, near array<int>, keys array<bigint>"),
        "described",
    )
    # Labels become numbers, so that a block's key is numeric whatever their type.
    listed = described.withColumn("key", F.explode("keys")).withColumn("label", F.xxhash64("label"))
    place = ["label", "dim", "key"]
    sizes = listed.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    blocks = (
        listed.drop("keys")
        .join(sizes, place)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")})
        .drop("parts", "other", "n")
    )
    ordered = [*place, "part_a", "part_b"]
    links = staged(
        blocks.repartition(*ordered)
        .sortWithinPartitions(*ordered)
        .mapInArrow(_verify(threshold), "node binary, links bigint, root binary"),
        "links",
    )
    families = connected_components(links.select("node", "root"), "node", "root")
    of_node = (
        nodes.select("node", "head", "copies")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(families.select(F.col("id").alias("node"), "cluster"), "node", "left")
        .select(
            "node", "head", F.coalesce("cluster", "node").alias("cluster"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    of_node = staged(of_node, "families")
    least = of_node.groupBy("cluster").agg(F.min("head").alias("component_id"))
    placed = staged(of_node.join(least, "cluster").select("node", "links", "component_id"), "placed")
    linked = keyed.select("vec_id", "node").join(placed, "node").select("vec_id", "links", "component_id")
    alone = _others(rows)
    component = F.coalesce("component_id", "vec_id")
    return linked.unionByName(alone).select(
        "vec_id",
        F.col("links").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _others(rows: DataFrame) -> DataFrame:
    """Rows that take no part: without a label or a usable vector."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    part = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    return rows.filter(~part).select(
        "vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component_id")
    )
