"""Near duplicates by cosine over sets of 3-word shingles.

Texts are compared through the shingles they share, never table against table:

1. Texts with equal shingle sets collapse to their lowest id first, so a group of copies costs one
   row however large it is.
2. Prefix filter (Bayardo et al. 2007): with shingles ordered rarest first, two sets of cosine >= t
   must share one of the first ``n - ceil(t^2 n) + 1`` shingles of each. Only these are joined.
3. Inside the posting list of a shingle every document is compared with the list's leader only: the
   one with the largest share of shingles that others have too, which for a family of near copies is
   the text they come from. What these links connect is one cluster from then on.
4. A link that is still missing lies between two clusters. Lists whose members are all of one cluster
   are done; in the others, members of different clusters are compared. The list of a family is gone by
   then, and a member leaves a list where nobody is of a size that it could be near to.

A pair is looked up only if all bounds leave it open: the sizes; the shingles that nobody else has (they
bound the size of a partner); the shingles left from the shared one on (positional filter); and small
bitmaps of the sets, whose bits that the other lacks are shingles that the other lacks.

The edges connect exactly the documents that all pairs above the threshold connect, while their number
grows with the documents and not with the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions import fixed_values as V
from ..functions.text import words
from ..session import bound_batches, cut_lineage

SHINGLE_WORDS = 3
SKETCH_WORDS = 8
#: Words that a worker makes sets of at a time.
WORDS_AT_A_TIME = 200_000
#: Copies whose row numbers are sent to every task that reads the sets.
FEW_COPIES = 500_000
#: What rounding may take from a cosine.
SLACK = 1e-12


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value depends on all others (the finaliser of murmur3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Weights of the words of a run, by their place in it; the last one is for the number of words.
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of three words, sorted and distinct per text, and the texts' offsets.

    A text of fewer words is its own single run.
    """
    counts = np.diff(at)
    hashes = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE_WORDS):
        hashes[: max(len(words) - k, 0)] += words[k:] * WEIGHTS[k]
    hashes += WEIGHTS[-1] * np.uint64(SHINGLE_WORDS)
    valid = np.ones(len(words), bool)
    long = counts >= SHINGLE_WORDS
    for k in range(1, SHINGLE_WORDS):  # these runs would reach into the next text
        valid[at[1:][long] - k] = False
    for t in np.flatnonzero(~long & (counts > 0)).tolist():
        a, b = at[t], at[t + 1]
        valid[a + 1 : b] = False
        hashes[a] = (np.append(words[a:b], np.uint64(b - a)) * WEIGHTS[[*range(b - a), -1]]).sum()
    sizes = np.where(long, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    out, ends = _mixed(hashes[valid]), np.cumsum(sizes)
    starts = ends - sizes
    for a, b in zip(starts.tolist(), ends.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], np.concatenate([[0], kept[ends]])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, set, digest, sketch) from (id, hashed words), some texts at a time."""
    for batch in batches:
        hashed = batch.column("hashed")
        at = hashed.offsets.to_numpy().astype(np.int64)
        at, flat, first = at - at[0], hashed.flatten().to_numpy().view(np.uint64), 0
        while first < len(batch):
            last = int(np.searchsorted(at, at[first] + WORDS_AT_A_TIME, "right")) - 1
            last = min(max(last, first + 1), len(batch))
            runs, ends = _runs(flat[at[first] : at[last]], at[first : last + 1] - at[first])
            sizes = np.diff(ends)
            said = np.flatnonzero(sizes)
            raw = [runs[a:b].tobytes() for a, b in zip(ends[said].tolist(), ends[said + 1].tolist())]
            bits = np.zeros((len(said), SKETCH_WORDS * 64), np.uint8)
            own = np.repeat(np.arange(len(said)), sizes[said])
            bits[own, (runs % np.uint64(SKETCH_WORDS * 64)).astype(np.int64)] = 1
            sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            offsets = np.concatenate([[0], ends[said + 1]]).astype(np.int32)
            places = np.arange(len(said) + 1, dtype=np.int32) * SKETCH_WORDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, last - first).take(pa.array(said)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs.view(np.int64))),
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(sketch.ravel())),
                ],
                ["id", "set", "digest", "sketch"],
            )
            first = last


def shingle_sets(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, its set of 3-word runs hashed to 64 bits and sorted, the set's digest and its bitmap.

    A text of fewer words is its own single run; a text without words has no set and drops out. The
    bitmap has ``SKETCH_WORDS`` words of 64 bits. A worker holds an Arrow batch, which is bounded by its
    bytes, and works on ``WORDS_AT_A_TIME`` words of it, or on one text.
    """
    bound_batches(df.sparkSession)
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    found = F.coalesce(hashed, F.array().cast("array<bigint>"))
    rows = df.select(F.col(id_column).alias("id"), found.alias("hashed"))
    numbers = ArrayType(LongType())
    schema = StructType([rows.schema["id"]]).add("set", numbers).add("digest", "binary").add("sketch", numbers)
    return rows.mapInArrow(_described, schema)


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets under their lowest id, and (id, copy_of) for all other ids.

    Sets are written once and not moved: digests tell which rows are copies, and those are left out
    wherever the sets are read.
    """
    rows = cut_lineage(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    head = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("h")
    heads = rows.groupBy("digest").agg(head, F.count("*").alias("rows")).filter("rows > 1").select(
        "digest", F.col("h.id").alias("copy_of"), F.col("h.row").alias("head")
    )
    named = rows.select("id", "digest", "row").join(heads, "digest")
    others = cut_lineage(named.filter("row <> head").select("row", "id", "copy_of"), "others")
    unique = rows.join(others.select("row"), "row", "left_anti").select("id", "set", "sketch")
    if others.count() > FEW_COPIES:
        # Too many to be sent to every task: the sets are moved, so they are moved once.
        unique = cut_lineage(unique, "unique")
    return unique, others.filter("id <> copy_of").select("id", "copy_of")


def _rank(df: Column, shingle: Column) -> Column:
    """A shingle as one number that puts rare ones first: 1/16 powers of two of ``df``, then its hash.

    Two shingles of one number share a list; that costs a look at most, as sets decide.
    """
    step = F.floor(F.log2(df) * 16).cast("bigint")
    return F.shiftleft(step, 53) + F.shiftrightunsigned(shingle, 11)


def prefix_postings(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, sketch, own, prefix): the shared shingles in the prefix of each set, rarest first.

    A shingle that occurs in one set only cannot be shared, so it is not followed further. It still
    takes its place at the front of the prefix, because the order has to be the same for all sets;
    ``own`` is the number of such shingles.
    """
    # Moved once: the counts and the join are made where the shingles are. Both read the same rows with
    # the same filter, so Spark takes the exchange of the one for the other.
    both = sets.select("id", F.explode("set").alias("shingle")).filter("id IS NOT NULL AND shingle IS NOT NULL")
    flat = both.repartition("shingle")
    shared = flat.groupBy("shingle").agg(F.count("id").alias("df")).filter("df > 1")
    # The list holds one document's own shingles.
    ranked = (
        flat.join(shared, "shingle")
        .select("id", _rank(F.col("df"), F.col("shingle")).alias("rank"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("rank")).alias("ranked"))
    )
    sized = sets.select("id", F.size("set").alias("n"), "sketch")
    prefix = F.col("n") - F.ceil(F.lit(threshold * threshold) * F.col("n") - 1e-9) + 1
    return (
        ranked.join(sized, "id")
        .withColumn("own", F.col("n") - F.size("ranked"))
        .withColumn("left", (prefix - F.col("own")).cast("int"))
        .filter("left > 0")
        .select("id", "n", "sketch", "own", F.slice("ranked", F.lit(1), "left").alias("prefix"))
    )


def _posted(lists: DataFrame, threshold: float, *keep: str) -> DataFrame:
    """(shingle, id, n, own, most, rest): one row per shingle of the prefixes.

    ``most`` is the size of the largest set that can be near in spite of the shingles nobody else has,
    ``rest`` the number of shingles from this one on.
    """
    common = (F.col("n") - F.col("own")).cast("double")
    most = common * common / (F.col("n") * (threshold - SLACK) ** 2)
    flat = lists.select("id", "n", "own", *keep, F.posexplode("prefix").alias("place", "shingle"))
    rest = F.col("n") - F.col("own") - F.col("place")
    return flat.select("shingle", "id", "n", "own", most.alias("most"), rest.alias("rest"), *keep)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold, with the cosine."""
    pairs = cut_lineage(pairs, "pairs")
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    # Only the sets of documents that are in a pair are moved to it.
    some = sets.join(asked, "id", "left_semi")
    a = some.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    b = some.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select(
            "a",
            "b",
            (shared / F.sqrt(F.size("set_a").cast("double") * F.size("set_b"))).alias("cosine"),
        )
        .filter(F.col("cosine") >= threshold - SLACK)
    )


def _bound(n_a: str, sketch_a: str, n_b: str, sketch_b: str) -> Column:
    """The highest cosine that two sets of these sizes and bitmaps can have."""

    def lacking(x: str, y: str) -> Column:
        """Shingles of x that y is sure not to have."""
        words = [
            F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i)))))
            for i in range(SKETCH_WORDS)
        ]
        return reduce(add, words)

    shared = F.least(
        F.col(n_a) - lacking(sketch_a, sketch_b), F.col(n_b) - lacking(sketch_b, sketch_a)
    )
    return shared / F.sqrt(F.col(n_a).cast("double") * F.col(n_b))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


OF_MEMBER = ["id", "n", "most", "rest"]


def _as_other(members: DataFrame) -> DataFrame:
    """The same postings under the names of a partner."""
    renamed = [F.col(c).alias(f"{c}_y") for c in members.columns if c != "shingle"]
    return members.select("shingle", *renamed)


def _open(threshold: float) -> Column:
    """Whether sizes and places leave open that two members of a list are near.

    The positional bound holds for the rarest shingle that two sets share; in its list it passes.
    """
    least = (threshold - SLACK) * F.sqrt(F.col("n").cast("double") * F.col("n_y"))
    return (
        (F.col("n") <= F.col("most_y"))
        & (F.col("n_y") <= F.col("most"))
        & (F.least("rest", "rest_y") >= least)
    )


def leader_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of a list with its leader, as far as they can be near.

    There is one pair per member at most, so bitmaps are looked at once the pairs are known.
    """
    posted = _posted(lists, threshold)
    share = (F.col("own") / F.col("n")).alias("share")
    leader = F.min(F.struct(share, "n", "id", "most", "rest")).alias("l")
    leaders = posted.groupBy("shingle").agg(leader).select(
        "shingle", *[F.col(f"l.{c}").alias(f"{c}_y") for c in OF_MEMBER]
    )
    met = posted.join(leaders, "shingle").filter((F.col("id") != F.col("id_y")) & _open(threshold))

    def of(name: str) -> DataFrame:
        return lists.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    pairs = met.select(*_ordered("id", "id_y")).distinct()
    bound = _bound("n_a", "sketch_a", "n_b", "sketch_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(bound >= threshold - SLACK).select("a", "b")


def cluster_pairs(lists: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of a list that are of different clusters, as far as they can be near.

    Sizes that can be near differ by one step of a scale at most, so lists are cut by it as well.
    """
    named = lists.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    posted = _posted(named, threshold, "cluster", "sketch").drop("own")
    several = posted.groupBy("shingle").agg(
        F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.min("n").alias("least")
    ).filter("low < high").select("shingle", "least")
    # Whoever is too small a part of everybody else in the list has no partner there.
    members = posted.join(several, "shingle").filter(F.col("most") >= F.col("least")).drop("least")
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold**2)) + 1e-9)
    members = cut_lineage(members.withColumn("band", step), "members")
    others = _as_other(members).withColumn("band", F.explode(F.array("band_y", F.col("band_y") - 1)))
    met = members.join(others, ["shingle", "band"]).filter(
        (F.col("cluster") != F.col("cluster_y"))
        & ((F.col("n") < F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("id") < F.col("id_y"))))
        & _open(threshold)
        & (_bound("n", "sketch", "n_y", "sketch_y") >= threshold - SLACK)
    )
    return met.select(*_ordered("id", "id_y")).distinct()


def _links(df: DataFrame, id_column: str, text: str, threshold: float):
    """Edges between copies and with leaders, the clusters of the latter, and edges between clusters."""
    unique, copies = collapse_copies(shingle_sets(df, id_column, text))
    copied = cut_lineage(copies.select(*_ordered("id", "copy_of"), F.lit(1.0).alias("cosine")), "copies")
    lists = cut_lineage(prefix_postings(unique, threshold), "lists")
    led = cut_lineage(_verified(leader_pairs(lists, threshold), unique, threshold), "led")
    clusters = cut_lineage(connected_components(led), "clusters")
    between = _verified(cluster_pairs(lists, clusters, threshold), unique, threshold)
    return copied, led, clusters, cut_lineage(between, "between")


def near_pairs(
    df: DataFrame, id_column: str, text: str, threshold: float = V.NEAR_DUPLICATE_COSINE
) -> DataFrame:
    """Edges (a < b, cosine) that connect all near duplicates; copies have cosine 1."""
    copied, led, _, between = _links(df, id_column, text, threshold)
    return copied.unionByName(led).unionByName(between)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, cluster): the lowest id that can be reached over the edges.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the rounds grow with the
    logarithm of the longest chain, and each round moves edges only, never a whole component.
    """

    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )

    links = cut_lineage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    )
    previous = None
    while True:
        # large star: hang every larger neighbour on the smallest one
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = (
            both.join(smallest(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        # small star: hang a node's smaller neighbours, and the node, on the smallest of them
        low = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pointed = low.join(smallest(low), "u")
        links = cut_lineage(
            pointed.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(pointed.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        # Same edges as before the round: every node hangs on the root of its component.
        state = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == previous:
            break
        previous = state
    members = links.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    roots = members.select(F.col("cluster").alias("id"), "cluster").distinct()
    return members.unionByName(roots)


def near_clusters(
    df: DataFrame, id_column: str, text: str, threshold: float = V.NEAR_DUPLICATE_COSINE
) -> DataFrame:
    """(id, cluster) for every document that has a near duplicate."""
    copied, _, clusters, between = _links(df, id_column, text, threshold)
    if not between.isEmpty():
        # What was found in between joins whole clusters, so only their names are followed.
        named = clusters.select(F.col("id").alias("a"), F.col("cluster").alias("a_in"))
        other = clusters.select(F.col("id").alias("b"), F.col("cluster").alias("b_in"))
        joined = between.join(named, "a", "left").join(other, "b", "left").select(
            F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")
        )
        merged = connected_components(joined).withColumnRenamed("cluster", "_in")
        old = clusters.withColumnRenamed("id", "_id").withColumnRenamed("cluster", "id")
        renamed = old.join(merged, "id", "left").select(
            F.col("_id").alias("id"), F.coalesce("_in", "id").alias("cluster")
        )
        alone = merged.join(clusters, "id", "left_anti").withColumnRenamed("_in", "cluster")
        clusters = cut_lineage(renamed.unionByName(alone), "clusters")
    # A copy is where its original is; originals have the lowest id of their copies.
    copies = copied.select(F.col("a").alias("id"), "b")
    placed = copies.join(clusters, "id", "left").select(
        "id", "b", F.coalesce("cluster", "id").alias("cluster")
    )
    originals = placed.select("id", "cluster").distinct().join(clusters, "id", "left_anti")
    return clusters.unionByName(originals).unionByName(placed.select(F.col("b").alias("id"), "cluster"))


def keep_best(df: DataFrame, clusters: DataFrame, id_column: str, text: str) -> DataFrame:
    """The document with the longest text of every cluster, and all documents without one."""
    # The lengths are taken first, so that no text is moved to find the longest.
    sized = df.select(id_column, F.length(text).alias("size"))
    joined = sized.join(clusters.withColumnRenamed("id", id_column), id_column, "left").withColumn(
        "cluster", F.coalesce("cluster", id_column)
    )
    best = (
        joined.groupBy("cluster")
        .agg(F.max(F.struct("size", (-F.col(id_column)).alias("neg"))).alias("b"))
        .select((-F.col("b.neg")).alias(id_column), "cluster")
    )
    return df.join(best, id_column)


def removal_report(n_all: DataFrame, n_kept: DataFrame) -> DataFrame:
    """How many documents went, in absolute numbers and percent."""
    kept = n_kept.agg(F.count("*").alias("kept"))
    return n_all.agg(F.count("*").alias("documents")).withColumn("kept", kept.scalar()).select(
        "documents",
        "kept",
        (F.col("documents") - F.col("kept")).alias("removed"),
        F.round(F.try_divide(F.col("documents") - F.col("kept"), F.col("documents")) * 100, 6).alias(
            "removed_percentage"
        ),
    )
