"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every text becomes its set of five-word shingles. Texts with equal sets collapse to one node, so
   a group of copies costs one row however large it is.
2. A node gets 240 minimum hashes. Each run of six is a band; nodes that agree on a whole band meet
   in a bucket. A pair of similarity 0.75 misses all 40 bands with probability 4e-4, one of 0.8
   with 5e-6.
3. First every member of a bucket is held against the bucket's smallest node only. What that links
   is merged into families. A second pass compares, per bucket, the members outside the family of
   the smallest node with all members of other families. So every two nodes of a bucket are either
   compared or already known to be connected. The second pass works on blocks of nodes, bounded by
   the shingles on either side. A pair is compared in the first band it shares, and a block gives at
   most one link per node and family, so no row is made for a pair that does not link.
4. A candidate's signatures are read in batches of 30 hashes. With m of n hashes equal and a uniform
   prior, the similarity's posterior is Beta(m + 1, n - m + 1); a pair is dropped as soon as the
   chance that it reaches the threshold falls below ``miss``.
5. Survivors are confirmed on the full sets: 100 * intersection >= 75 * union.

A shingle is held as a 64-bit hash. Sets are compared within pairs only, where a collision has a
chance of about (set size)^2 / 2^64; it does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neardup import connected_components
from .common import (
    U64, Words, distinct_per_text, fixed_binary, list_column, matrix, mix, prepare, random_words,
    shingles, sorted_blocks, staged, text_chunks,
)

BANDS = 40
BAND_HASHES = 6
HASHES = BANDS * BAND_HASHES
BATCH_HASHES = 30
THRESHOLD_PERCENT = 75
#: Chance per batch that a pair at or above the threshold is dropped on its signature.
MISS = 1e-5
#: Shingles of a bucket's nodes on either side of a block; a larger node is a side of its own.
PART_SHINGLES = 500_000


def _sets(data, offsets, words: Words):
    return distinct_per_text(*shingles(*words(data, offsets)))


def _digests(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = values.astype("<u8").tobytes()
    return [
        hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])
    ]


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``HASHES`` 32-bit minima per set; all sets must have values."""
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    if not len(out):
        return out
    low = (values >> U64(32)).astype(np.uint32)
    salt = random_words(2 * HASHES, 11)
    flips = (salt[:HASHES] >> U64(32)).astype(np.uint32)
    factors = (salt[HASHES:] >> U64(32)).astype(np.uint32) | np.uint32(1)
    work = np.empty_like(low)
    for i in range(HASHES):
        np.bitwise_xor(low, flips[i], out=work)
        np.multiply(work, factors[i], out=work)
        out[:, i] = np.minimum.reduceat(work, at[:-1])
    return out


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    weights = random_words(BAND_HASHES, 17) | U64(1)
    runs = hashes.reshape(len(hashes), BANDS, BAND_HASHES).astype(U64)
    return mix((runs * weights).sum(axis=2) + random_words(BANDS, 19))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, node, sig, keys) per document."""
    words = Words()
    for rows, data, offsets in text_chunks(batches):
        values, at = _sets(data, offsets, words)
        sizes = np.diff(at)
        full = sizes > 0
        hashes = signatures(values, np.concatenate([at[:-1][full], at[-1:]]))
        nodes = [d if n else None for d, n in zip(_digests(values, at), sizes)]
        sig, keys = np.zeros((len(rows), HASHES), np.uint8), _band_keys(hashes).view(np.int64)
        sig[full] = (hashes ^ (hashes >> np.uint32(16))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(nodes, pa.binary()),
                fixed_binary(sig),
                list_column(keys.ravel(), np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int64()),
            ],
            ["doc_id", "n_shingles", "node", "sig", "keys"],
        )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of texts that take part in a comparison."""
    words = Words()
    for _, data, offsets in text_chunks(batches):
        values, at = _sets(data, offsets, words)
        raw = values.astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_digests(values, at), pa.binary()),
                pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary()),
            ],
            ["node", "shingles"],
        )


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of batches read, the least equal hashes with which a pair goes on.

    Signatures keep 8 bits of each minimum, so unequal ones agree by chance once in 256.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH_HASHES, HASHES + 1, BATCH_HASHES):
        below, m = 0.0, -1  # P(Beta(m + 1, n - m + 1) >= p) = P(Binomial(n + 1, p) <= m)
        while below < miss:
            m += 1
            below += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def _survivors(threshold: float):
    bounds = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = matrix(batch.column("sig_a"), np.uint8, HASHES)
            b = matrix(batch.column("sig_b"), np.uint8, HASHES)
            live, equal = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for i, least in enumerate(bounds):
                part = slice(i * BATCH_HASHES, (i + 1) * BATCH_HASHES)
                equal[live] += (a[live, part] == b[live, part]).sum(axis=1)
                live = live[equal[live] >= least]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return run


def _are_near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct shingles have the similarity."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                [np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(c)] for c in ("set_a", "set_b")
            ]
            good = [i for i, (x, y) in enumerate(zip(*sets)) if _are_near(x, y, percent)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _block_links(percent: int):
    """Links (a, b) between a block's x and y rows: at most one per x and family of y."""
    bounds = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches, ["key", "part_x", "part_y"]):
            names = block["node"].to_pylist()
            family = block["family"].combine_chunks().dictionary_encode().indices.to_numpy()
            apart = block["apart"].to_numpy(zero_copy_only=False)
            is_x = block["is_x"].to_numpy(zero_copy_only=False)
            sig = matrix(block["sig"], np.uint8, HASHES)
            keys = np.stack(block["keys"].to_numpy(zero_copy_only=False))
            sets = [np.frombuffer(v, "<u8") for v in block["shingles"].to_pylist()]
            key = block["key"][0].as_py()
            xs, ys = np.flatnonzero(is_x), np.flatnonzero(~is_x)
            step = max(1, (8 << 20) // (BATCH_HASHES * max(len(ys), 1)))
            links: dict[tuple[int, int], int] = {}
            for first in range(0, len(xs), step):
                x = xs[first : first + step]
                equal = (sig[x, None, :BATCH_HASHES] == sig[None, ys, :BATCH_HASHES]).sum(axis=2)
                a, b = np.nonzero((equal >= bounds[0]) & (family[x][:, None] != family[ys]))
                equal, a, b = equal[a, b], x[a], ys[b]
                for i, least in enumerate(bounds[1:], 1):
                    part = slice(i * BATCH_HASHES, (i + 1) * BATCH_HASHES)
                    equal = equal + (sig[a, part] == sig[b, part]).sum(axis=1)
                    live = equal >= least
                    equal, a, b = equal[live], a[live], b[live]
                band = (keys[a] == keys[b]).argmax(axis=1)
                live = keys[a, band] == key
                equal, a, b = equal[live], a[live], b[live]
                order = np.argsort(-equal, kind="stable")  # the likeliest first
                for i, j in zip(a[order].tolist(), b[order].tolist()):
                    # Two nodes that are both x meet twice.
                    if (i, int(family[j])) in links or apart[j] and names[i] > names[j]:
                        continue
                    if _are_near(sets[i], sets[j], percent):
                        links[i, int(family[j])] = j
            if links:
                pairs = [sorted((names[i], names[j])) for (i, _), j in links.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(side), pa.binary()) for side in zip(*pairs)], ["a", "b"]
                )

    return run


def _surviving_star(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's smallest node and another one that survive on their signatures."""

    def sig(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"))

    return (
        members.select(F.col("first").alias("a"), F.col("node").alias("b"))
        .distinct()
        .join(sig("a"), "a")
        .join(sig("b"), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_survivors(percent / 100), "a binary, b binary")
    )


def _full_sets(of: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes asked for, made anew from the text of one document each."""
    asked = of.select("node").distinct()
    heads = nodes.select("node", "head").join(asked, "node").select("head").distinct()
    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    made = texts.select("text").mapInArrow(_set_rows, "node binary, shingles binary")
    # An id that two texts share brings a second set, which nobody asked for.
    return staged(made.join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _star_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between a bucket's smallest node and its other members."""
    kept = staged(_surviving_star(members, nodes, percent), "survivors")
    sets = _full_sets(kept.select(F.col("a").alias("node")).union(kept.select("b")), nodes, docs)

    def full(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))

    return staged(
        kept.join(full("a"), "a")
        .join(full("b"), "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(_confirm(percent), "a binary, b binary"),
        "links",
    )


def _rest_links(
    members: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame, percent: int
) -> DataFrame:
    """Links inside buckets between nodes that are not yet of one family."""

    def family(name: str, out: str) -> DataFrame:
        return found.select(F.col("id").alias(name), F.col("cluster").alias(out))

    placed = (
        members.join(family("node", "f"), "node", "left")
        .join(family("first", "g"), "first", "left")
        .select("key", "node", F.coalesce("f", "node").alias("family"), F.coalesce("g", "first").alias("main"))
        .withColumn("apart", F.col("family") != F.col("main"))
        .drop("main")
        .join(nodes.select("node", "n_shingles"), "node")
    )
    placed = staged(placed, "placed")
    size = F.col("n_shingles")
    parts = placed.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("apart"), size)) / PART_SHINGLES).cast("int").alias("parts_x"),
        F.ceil(F.sum(size) / PART_SHINGLES).cast("int").alias("parts_y"),
    )
    parted = placed.join(parts.filter("parts_x > 0"), "key").withColumns(
        {f"part_{s}": F.pmod(F.xxhash64("node"), F.col(f"parts_{s}")).cast("int") for s in "xy"}
    )
    parted = staged(parted, "parted")
    sets = _full_sets(parted, nodes, docs)

    def side(rows: DataFrame, is_x: bool, other: str) -> DataFrame:
        """Every row once for each part of the other side."""
        spread = F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1))
        return rows.withColumn(f"part_{other}", spread).select(
            "key", "part_x", "part_y", "node", "family", "apart", F.lit(is_x).alias("is_x")
        )

    sides = side(parted.filter("apart"), True, "y").unionByName(side(parted, False, "x"))
    block = ["key", "part_x", "part_y"]
    return staged(
        sides.join(nodes.select("node", "sig", "keys"), "node")
        .join(sets, "node")
        .repartition(*block)
        .sortWithinPartitions(*block)
        .mapInArrow(_block_links(percent), "a binary, b binary"),
        "links",
    )


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Null, empty and wordless texts have an empty set and link with nothing. Rows that repeat a
    doc_id each give a row; a null doc_id is a copy like any other, but no component is named after
    it while it has another member. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    described = staged(
        docs.mapInArrow(
            _describe, "doc_id bigint, n_shingles bigint, node binary, sig binary, keys array<bigint>"
        ),
        "described",
    )
    nodes = staged(
        described.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("head"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
            F.first("keys").alias("keys"),
        ),
        "nodes",
    )
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = (
        bands.groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .filter("first <> last")
        .select("key", "first")
    )
    members = staged(bands.join(shared, "key").filter("node <> first"), "members")
    links = _star_links(members, nodes, docs, percent)
    found = staged(connected_components(links), "families")
    more = _rest_links(members, nodes, found, docs, percent)
    families = staged(connected_components(links.unionByName(more)), "families")
    heads = nodes.select("node", "head").join(
        families.select(F.col("id").alias("node"), "cluster"), "node", "left"
    )
    heads = heads.select("head", "node", F.coalesce("cluster", "node").alias("cluster"))
    least = heads.groupBy("cluster").agg(F.min("head").alias("component_id"))
    of_node = staged(heads.join(least, "cluster").select("node", "component_id"), "components")
    component = F.coalesce("component_id", "doc_id")
    return (
        described.select("doc_id", "n_shingles", "node")
        .join(of_node, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        )
    )
