"""Search over an embedded text column: index, exact and bounded top-k, refresh, chunks."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import WORD_GAP
from ..session import bound_batches, cut_lineage
from .curate import text_digest

DIMS = 64
#: Bytes of vectors on either side of a block, whatever their length. Each row is moved once for every block of
#: queries and the other way round, so larger blocks move less.
BLOCK_BYTES = 32 << 20
#: Scores that a task holds at a time, rows that they are of, and rows in a group of which only the best is ranked.
TILE_SCORES, TILE_ROWS, GROUPS = 1 << 18, 512, 32
#: Blocks that a core should have to share work evenly, and pairs of a block that are not worth a further cut.
BLOCKS_PER_CORE, LEAST_PAIRS = 4, 1 << 24
#: What two ways of adding up, and rounding to ``SCORE_DIGITS``, may change in a score.
SCORE_SLACK = 2e-9
#: Bytes of vectors whose scores are added up anew at a time, and queries whose angles to all centres are held.
PAIR_BYTES, ASKED = 4 << 20, 512
SCORE_DIGITS = 9
#: Vectors that cells are fitted on at most; a cell should have some of them, so cells are bounded too.
SAMPLE_ROWS = 20_000
SAMPLE_PER_CELL = 16
#: A query that would have to look at more of the rows than this share is compared with all of them.
MOST_SHARE = 0.25
EVERYWHERE = -1
#: Bins of the angle between a vector and the centre of its cell.
ANGLES = 64
#: What rounding may add to an angle.
SLACK = 1e-7
#: Words that are hashed at a time, and the longest that fit into one block of md5.
HASHED, ONE_BLOCK = 1 << 15, 55


def word_bucket(word: str, dims: int = DIMS) -> int:
    """First 32 bits of the word's md5, modulo the number of dimensions."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dims


_IN_WORD = np.array([not re.match(WORD_GAP, chr(c)) if c < 128 else True for c in range(256)])
_MD5_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_heads(message: list[np.ndarray | None], n: int) -> np.ndarray:
    """First 32 bits of the md5 of ``n`` messages of one block each; ``message`` are its 16 numbers, None for 0.

    The digest begins with what the fourth last of the 64 steps gives, so the last three are left out.
    """
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    f = np.empty(n, np.uint32)
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        part = message[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if part is not None:
            f += part
        f += a
        f += np.uint32(_MD5_ADDED[i])
        turn = _MD5_TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_MD5_START[0])).byteswap()


def _buckets(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    """:func:`word_bucket` of the words that lie at ``starts`` of a buffer of UTF-8, many at a time."""
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    eights = np.ndarray(len(data) + 57, "<u8", padded, strides=(1,))  # eight bytes from any place
    out, parts = np.zeros(len(starts), np.int64), sizes // 8 + 1
    for n in range(1, ONE_BLOCK // 8 + 2):
        own = np.flatnonzero((parts == n) & (sizes <= ONE_BLOCK))
        for first in range(0, len(own), HASHED):
            at = own[first : first + HASHED]
            message: list[np.ndarray | None] = [None] * 16
            for j in range(n):
                part = eights[starts[at] + 8 * j]
                if j == n - 1:  # the word ends here: what follows goes, a bit marks the end
                    end = (8 * (sizes[at] - 8 * j)).astype(np.uint64)
                    mark = np.uint64(1) << end
                    part = part & (mark - np.uint64(1)) | mark << np.uint64(7)
                message[2 * j], message[2 * j + 1] = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            message[14] = (8 * sizes[at]).astype(np.uint32)
            out[at] = _md5_heads(message, len(at)) % np.uint32(dims)
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        head = hashlib.md5(data[starts[i] : starts[i] + sizes[i]]).digest()[:4]
        out[i] = int.from_bytes(head, "big") % dims
    return out


def _word_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """Words of each bucket in each text. Texts are cut as ``functions.text.words`` cuts them, at the bytes
    between words, all of which are ASCII."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.zeros(0, np.uint8)
    edges -= edges[0]
    inside = np.zeros(len(data) + 1, bool)
    np.take(_IN_WORD, data, out=inside[:-1])
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text ends a word and begins one.
    cuts = edges[1:-1]
    begins[cuts] = inside[cuts]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    many = np.diff(np.searchsorted(starts, edges))
    at = np.repeat(np.arange(len(texts)) * dims, many) + _buckets(data, starts, sizes, dims)
    return np.bincount(at, minlength=dims * len(texts)).reshape(-1, dims)


def _list_column(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def embed(df: DataFrame, text: str, out: str = "embedding", dims: int = DIMS) -> DataFrame:
    """Add hashed word counts scaled to length 1, the stand-in for a hosted embedding model.

    A text without words gets a zero vector. Texts go to Python as they are; words are found and hashed there
    for a whole batch at a time, and nothing is exploded or shuffled. Batches are bounded by bytes.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        counted = _word_counts(texts, dims)
        norms = np.sqrt((counted**2).sum(axis=1, keepdims=True))
        return _list_column(counted / np.maximum(norms, 1))

    return df.withColumn(out, counts(F.coalesce(F.lower(text), F.lit(""))))


def build_search_index(df: DataFrame, id_column: str, text: str, attributes: list[str]) -> DataFrame:
    """id, attributes, digest of the indexed text, embedding."""
    return embed(df.withColumn("digest", text_digest(text)), text).select(
        id_column, *attributes, "digest", "embedding"
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column scaled to length 1, zero rows stay zero."""
    if not len(column):
        return np.zeros((0, 1))
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    m, at = None, 0
    for chunk in chunks:
        rows = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
        if m is None:
            m = np.empty((len(column), rows.shape[1]))
        m[at : at + len(rows)] = rows
        at += len(rows)
    for at in range(0, len(m), TILE_ROWS):
        rows = m[at : at + TILE_ROWS]
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        np.divide(rows, norms, out=rows, where=norms > 0)
        rows[~(norms[:, 0] > 0)] = 0
    return m


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query; equal scores in order of the id."""
    scores = np.round(scores, SCORE_DIGITS) + 0.0
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


SCORES_SCHEMA = "query_id bigint, corpus_id bigint, score double, compared bigint"


def _score_rows(
    queries: np.ndarray, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, compared: np.ndarray
) -> pa.Table:
    """Hits of each query in a block, in the order of ``owner``, the places of their queries. The first row of
    a query says how many rows were compared; a query without hits has one row without an id."""
    hits = np.bincount(owner, minlength=len(queries))
    sizes = np.maximum(hits, 1)
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    at = np.arange(len(owner)) + (first - (np.cumsum(hits) - hits))[owner]
    own, score, counts = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    own[at], score[at], counts[first] = ids, scores, compared
    missing = np.ones(n, bool)
    missing[at] = False
    return pa.table(
        {
            "query_id": pa.array(np.repeat(queries, sizes), pa.int64()),
            "corpus_id": pa.array(own, pa.int64(), mask=missing),
            "score": pa.array(score, pa.float64()),
            "compared": pa.array(counts, pa.int64()),
        }
    )


def _pairs_at_a_time(block: np.ndarray) -> int:
    return max(1, PAIR_BYTES // (8 * block.shape[1]))


def _without_more_copies(ids: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be hits: of rows with the same vector the k lowest ids are."""
    if len(ids) <= k:
        return np.arange(len(ids))
    weights = np.random.default_rng(7).integers(0, 1 << 63, block.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = np.ascontiguousarray(block).view(np.uint64) @ weights
    order = np.lexsort((ids, hashed))
    hashed = hashed[order]
    heads = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1]))
    sizes = np.diff(np.append(heads, len(ids)))
    kept = np.ones(len(ids), bool)
    step = _pairs_at_a_time(block)
    for head, size in zip(heads[sizes > k].tolist(), sizes[sizes > k].tolist()):
        run = order[head : head + size]
        if all((block[run[i : i + step]] == block[run[0]]).all() for i in range(0, size, step)):
            kept[run[k:]] = False
    return np.flatnonzero(kept)


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask is true; its size is a multiple of 64, and few of it is true."""
    eights = mask.view(np.uint64) != 0
    some = np.flatnonzero(eights.view(np.uint64))
    at = np.flatnonzero(eights.reshape(-1, 8)[some])
    some = some[at >> 3] * 8 + (at & 7)
    at = np.flatnonzero(mask.reshape(-1, 8)[some])
    return some[at >> 3] * 8 + (at & 7)


def _settled(
    owner: np.ndarray, row: np.ndarray, ids: np.ndarray, block: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of the pairs of each query, by query and rank; equal scores in order of the id."""
    scores, step = np.empty(len(row)), _pairs_at_a_time(block)
    for at in range(0, len(row), step):
        part = slice(at, at + step)
        scores[part] = np.einsum("ij,ij->i", block[row[part]], queries[owner[part]])
    scores = np.round(scores, SCORE_DIGITS) + 0.0
    order = np.lexsort((ids[row], -scores, owner))
    ordered = owner[order]
    best = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]
    return best, scores[best]


def _hits(
    ids: np.ndarray, block: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the queries, ids, scores) of the k best rows of a block for each query, by query and rank.

    Some queries meet some rows in one matrix product of 32-bit numbers. What they leave open is less than
    ``slack``: the sum of ``width`` products of numbers rounded to 24 bits is off by ``(width + 3) / 2**24`` at
    most for vectors of length 1, once in the score and once in the k-th best one. Pairs that reach the k-th best
    score so far are scored again by themselves. With ``floors`` k rows are known that score as much.
    """
    none = np.zeros(0, np.int64)
    found: list[tuple] = [(none, none, np.zeros(0))]
    rows = _without_more_copies(ids, block, k)
    if len(rows) < len(ids):
        ids, block = ids[rows], block[rows]
    small, slack = block.astype(np.float32), SCORE_SLACK + (block.shape[1] + 8) / 2**22
    wide = max(min(len(block), TILE_ROWS), 1)
    step = max(1, min(TILE_SCORES // wide, len(queries)))
    tile = np.empty(step * wide, np.float32)  # the same memory again and again
    reach = np.empty(-(-len(tile) // 64) * 64, bool)
    for first in range(0, len(queries) if len(block) else 0, step):
        asked = queries[first : first + step]
        n, asked_small = len(asked), asked.astype(np.float32)
        most = max(TILE_SCORES // 2, 2 * n * k)
        floor = np.full(n, -np.inf, np.float32)
        if floors is not None:
            floor = (floors[first : first + step] - slack).astype(np.float32)
        top = np.full((n, k), -np.inf, np.float32)
        owner, row, score = none, none, np.zeros(0, np.float32)
        for at in range(0, len(small), TILE_ROWS):
            some = small[at : at + TILE_ROWS]
            width = len(some)
            end = n * width
            scores = np.matmul(asked_small, some.T, out=tile[:end].reshape(n, width))
            if at == 0 and width >= k:
                cut = width // GROUPS * GROUPS
                tops = scores[:, :cut].reshape(n, GROUPS, -1).max(axis=1) if cut >= GROUPS * k else scores
                floor = np.maximum(floor, np.partition(tops, -k, axis=1)[:, -k] - np.float32(slack))
            np.greater_equal(scores, floor[:, None], out=reach[:end].reshape(n, width))
            whole = -(-end // 64) * 64
            reach[end:whole] = False
            near = _places(reach[:whole])
            if not len(near):
                continue
            own, place = np.divmod(near, width)
            reached = tile[near]
            who, many = np.unique_counts(own)
            both = np.full((len(who), k + many.max()), -np.inf, np.float32)
            both[:, :k] = top[who]
            starts = np.cumsum(many) - many
            both[np.repeat(np.arange(len(who)), many), k + np.arange(len(near)) - np.repeat(starts, many)] = reached
            top[who] = np.partition(both, -k, axis=1)[:, -k:]
            floor[who] = np.maximum(floor[who], top[who, 0] - np.float32(slack))
            owner, row = np.concatenate([owner, own]), np.concatenate([row, at + place])
            score = np.concatenate([score, reached])
            if len(row) > most:
                open_ = score >= floor[owner]
                owner, row, score = owner[open_], row[open_], score[open_]
                if len(row) > most:
                    best, _ = _settled(owner, row, ids, block, asked, k)
                    owner, row, score = owner[best], row[best], score[best]
        open_ = score >= floor[owner]
        owner, row = owner[open_], row[open_]
        best, exact = _settled(owner, row, ids, block, asked, k)
        found.append((first + owner[best], ids[row[best]], exact))
    owner, own, exact = (np.concatenate(x) for x in zip(*found))
    return owner, own, exact


def _nearest(ids: np.ndarray, block: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(ids, scores) of the k best rows of a block for each query."""
    owner, own, scores = _hits(ids, block, queries, k)
    ends = np.searchsorted(owner, np.arange(len(queries) + 1)).tolist()
    return [(own[a:b], scores[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _block_scores(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best k rows of one block of the corpus for each query, but for those below a query's floor if it has one."""

    def score(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        ids, block = corpus.column("corpus_id").to_numpy(), _matrix(corpus.column("embedding"))
        asked = queries.column("query_id").to_numpy()
        if not len(ids):
            asked = asked[:0]
        floors = queries.column("_floor").to_numpy() if "_floor" in queries.column_names else None
        owner, own, scores = _hits(ids, block, _matrix(queries.column("embedding"))[: len(asked)], k, floors)
        if floors is not None:
            better = scores >= floors[owner] - 10.0**-SCORE_DIGITS
            owner, own, scores = owner[better], own[better], scores[better]
        return _score_rows(asked, owner, own, scores, np.full(len(asked), len(ids)))

    return score


def _blocks(n: Column, width: int) -> Column:
    """Blocks that so many vectors of ``width`` components fill."""
    return F.greatest(F.ceil(n * (8 * width) / BLOCK_BYTES), F.lit(1).cast("bigint"))


def _width(df: DataFrame) -> int:
    """Components of the vectors of a table; all have the same."""
    row = df.select(F.size("embedding")).filter("embedding IS NOT NULL").first()
    return max(row[0], 1) if row else 1


def _grid(rows: DataFrame, queries: DataFrame, key: list[str], width: int) -> DataFrame:
    """Shards of the rows and stripes of the queries of each key, and the pairs that meet there.

    Bytes bound either side. Where that leaves fewer blocks than the cores can share evenly, both sides are cut
    further, as long as a block keeps some work.
    """
    many = F.count("*")
    counted = rows.groupBy(*key).agg(many.alias("_rows")).join(queries.groupBy(*key).agg(many.alias("_asked")), key)
    counted = cut_lineage(counted, "grid")
    pairs = F.col("_rows").cast("double") * F.col("_asked")
    total = counted.agg(F.sum(pairs)).first()[0] or 1.0
    wanted = F.least(pairs * (BLOCKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism / total), pairs / LEAST_PAIRS)
    shards, stripes = _blocks(F.col("_rows"), width), _blocks(F.col("_asked"), width)
    more = F.sqrt(F.greatest(wanted / (shards * stripes), F.lit(1.0)))
    return counted.select("*", F.ceil(shards * more).alias("_shards"), F.ceil(stripes * more).alias("_stripes"))


def _tasks(grid: DataFrame, width: int) -> int:
    """Tasks for the blocks of a grid: by the pairs to compare, not by the bytes that are moved."""
    block = BLOCK_BYTES / (8 * width)
    pairs = F.col("_rows").cast("double") * F.col("_asked")
    blocks, work = grid.agg(
        F.sum(F.col("_shards") * F.col("_stripes")), F.sum(pairs) / (block * block)
    ).first()
    least = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(blocks or 1, max(least, 2 * int(work or 0))))


def _in_grid(corpus: DataFrame, queries: DataFrame, key: list[str], width: int):
    """Both sides cut into blocks that meet: the rows by shard, the queries by stripe.

    A key may hold any part of either table; a group is one shard and one stripe. The number of tasks
    follows from the pairs to compare, which grow faster than the rows.
    """
    grid = _grid(corpus, queries, key, width)
    tasks, zero = _tasks(grid, width), F.lit(0).cast("bigint")
    left = corpus.join(grid, key).select(
        *corpus.columns,
        F.pmod(F.xxhash64("corpus_id"), F.col("_shards")).alias("_shard"),
        F.explode(F.sequence(zero, F.col("_stripes") - 1)).alias("_stripe"),
    )
    right = queries.join(grid, key).select(
        *queries.columns,
        F.explode(F.sequence(zero, F.col("_shards") - 1)).alias("_shard"),
        F.pmod(F.xxhash64("query_id"), F.col("_stripes")).alias("_stripe"),
    )
    block = [*key, "_shard", "_stripe"]
    sides = [side.repartition(tasks, *block).groupBy(*block) for side in (left, right)]
    return sides[0].cogroup(sides[1])


def _asking(queries: DataFrame, *keep: str | Column) -> DataFrame:
    """Queries that say something: a zero vector is near to nothing and has no hits.

    They are stored before that is asked, because a filter on vectors would embed them once more.
    """
    kept = cut_lineage(queries.select(F.col("query_id").cast("bigint"), "embedding", *keep), "asked")
    return kept.filter(F.exists("embedding", lambda x: x != 0))


def _known(names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).isNotNull()
    return out


def block_scores(
    corpus: DataFrame, queries: DataFrame, k: int, attributes: list[str] | None = None
) -> DataFrame:
    """Partial top-k of every corpus block for every query.

    ``corpus`` is (corpus_id, embedding), ``queries`` (query_id, embedding). With ``attributes`` both
    have these columns too, and a query meets the rows that equal it in all of them; a null equals
    nothing. No pair outside a block's top k leaves its task, nor one that scores less than the query's
    ``_floor``, if ``queries`` has such a column; it must be a score that k rows reach.
    """
    names = attributes or []
    floor = [c for c in queries.columns if c == "_floor"]

    def cell(id_column: str) -> Column:
        # Without attributes all rows are one cell; a literal would turn the join into a product.
        return F.xxhash64(F.col(id_column).isNull(), *names).alias("_cell")

    rows = corpus.filter(_known(names)).select(
        F.col("corpus_id").cast("bigint"), "embedding", cell("corpus_id")
    )
    # Counting the rows needs no vectors, so the corpus is embedded once only.
    asked = _asking(queries.filter(_known(names)), cell("query_id"), *floor)
    met = _in_grid(rows, asked, ["_cell"], _width(asked))
    return met.applyInArrow(_block_scores(k), SCORES_SCHEMA)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """The k best of the partial results of each query: one row per block and place at most."""
    in_query = W.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return (
        partial.filter("corpus_id IS NOT NULL").withColumn("rank", F.row_number().over(in_query).cast("bigint"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "corpus_id", F.round("score", 6).alias("score"))
    )


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_K,
    attributes: list[str] | None = None,
) -> DataFrame:
    """(query_id, rank, corpus_id, score): the k nearest rows by cosine, exact.

    ``k`` of 0 or None means the default. Equal scores rank by id. A query without words has no
    hits. With ``attributes`` only rows that share the query's values are searched, all values in
    one pass over the index.
    """
    k = k or V.TOP_K
    return _ranked(block_scores(corpus, queries, k, attributes), k)


def compared_with_corpus(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query against every corpus row: rows compared and the best match."""
    best = F.max_by(F.col("corpus_id"), F.struct("score", (-F.col("corpus_id")).alias("neg")))
    return (
        block_scores(corpus, queries, 1)
        .groupBy("query_id")
        .agg(
            F.sum("compared").alias("n_compared"),
            best.alias("best_id"),
            F.round(F.max("score"), 6).alias("best_score"),
        )
    )


def filter_attributes(index: DataFrame, **wanted) -> DataFrame:
    """Equality filters on the index attributes; they reach the scan of the index table."""
    for column, value in wanted.items():
        index = index.filter(F.col(column) == F.lit(value))
    return index


def write_index(index: DataFrame, path: str) -> None:
    """Store an index; later searches read the columns they need instead of embedding anew."""
    index.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored index, or some of its columns."""
    index = spark.read.parquet(path)
    return index.select(*columns) if columns else index


def retrieve_text_chunks(
    queries: DataFrame, hits: DataFrame, corpus: DataFrame, text: str
) -> DataFrame:
    """(query_id, chunks): non-empty texts of the hits in rank order; no hits, an empty list.

    A query has at most k hits, so the list is bounded.
    """
    found = hits.join(corpus.select("corpus_id", F.col(text).alias("_text")), "corpus_id").filter(
        F.length("_text") > 0
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", "_text")))
    lists = found.groupBy("query_id").agg(F.transform(ranked, lambda r: r["_text"]).alias("chunks"))
    empty = F.array().cast("array<string>")
    return queries.select("query_id").join(lists, "query_id", "left").withColumn(
        "chunks", F.coalesce("chunks", empty)
    )


def refresh_index(
    index: DataFrame, source: DataFrame, id_column: str, text: str, attributes: list[str]
) -> DataFrame:
    """The index brought up to date: only new and changed texts are embedded again.

    Rows whose id left the source go; ``refreshed`` tells what was embedded.
    """
    digested = source.withColumn("digest", text_digest(text))
    current = index.join(digested.select(id_column, "digest"), [id_column, "digest"], "left_semi")
    stale = digested.join(current.select(id_column), id_column, "left_anti")
    return current.withColumn("refreshed", F.lit(False)).unionByName(
        build_search_index(stale, id_column, text, attributes).withColumn("refreshed", F.lit(True))
    )


def chunk_documents(
    df: DataFrame, id_column: str, text: str, keep: list[str], size: int = 500, overlap: int = 50
) -> DataFrame:
    """(id, chunk_no, chunk_text): pieces of fixed size, each overlapping the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)) - 1
    return (
        df.filter(F.length(text) > 0)
        .select(
            id_column,
            *keep,
            text,
            F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"),
        )
        .withColumn(
            "chunk_text",
            F.substr(F.col(text), (F.col("chunk_no") * step + 1).cast("int"), F.lit(size)),
        )
        .drop(text)
    )


def build_kb_articles(pairs: DataFrame) -> DataFrame:
    """Question and answer articles from answered tickets."""
    return pairs.select(
        F.concat_ws("-", "conv_id", "turn").alias("kb_id"),
        F.col("conv_id").alias("source_ticket_id"),
        F.col("body").alias("body_question"),
        F.col("answer").alias("body_answer"),
    )


def _fit_centres(vectors: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Directions that a sample of unit vectors gathers around (spherical k-means)."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.zeros_like(centres)
        sums[own[order][first]] = np.add.reduceat(vectors[order], first)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        # A centre that nobody is nearest to starts again at some vector.
        lost = np.flatnonzero(norms[:, 0] == 0)
        sums[lost] = vectors[rng.choice(len(vectors), len(lost))]
        centres = sums / np.where(norms > 0, norms, 1)
    return centres


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


@dataclass
class CellIndex:
    """Vectors by the cell of the nearest centre, and how far from it they lie.

    A vector at angle ``a`` from its centre is at least ``|t - a|`` away from a query that is ``t`` away
    from the centre. So once a query has k hits, a cell can only hold a better one among the rows whose
    angle is nearer to ``t`` than the worst hit is to the query; ``counts`` tells how many those are.
    """

    rows: DataFrame  # corpus_id, embedding, _cell, _angle, attributes
    centres: np.ndarray
    counts: np.ndarray  # rows per cell and bin of the angle
    attributes: list[str]

    def _probes(self, k: int, missed: int) -> tuple[Callable, Callable]:
        """Functions for the cells that a query should look into, and its angle to their centres.

        Without hits so far these are the nearest cells that hold k rows. With them, the cells where
        rows could be better than the worst hit, but for those looked into before and for cells that hold
        no more than ``missed`` of such rows together.
        """
        centres, counts = self.centres, self.counts
        held = counts.sum(axis=1)
        width, everywhere = np.pi / ANGLES, np.array([EVERYWHERE])
        below = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)

        at, total = np.arange(len(counts)), held.sum()

        def first(angles: np.ndarray) -> list[np.ndarray]:
            nearest = angles.argmin(axis=1)
            chosen = list(nearest[:, None])
            for i in np.flatnonzero(held[nearest] < k).tolist():
                order = np.argsort(angles[i], kind="stable")
                chosen[i] = order[: np.searchsorted(np.cumsum(held[order]), k) + 1]
            return chosen

        def rest(angles: np.ndarray, scores: np.ndarray, had: list[np.ndarray]) -> list[np.ndarray]:
            reach = (_angle(scores - 10.0**-SCORE_DIGITS) + SLACK)[:, None]
            # Bins that rounding leaves open are looked into as well.
            low = np.floor(np.clip(angles - reach, 0, np.pi) / width - 1e-9).astype(np.int64)
            high = np.ceil(np.clip(angles + reach, 0, np.pi) / width + 1e-9).astype(np.int64)
            low, high = np.clip(low, 0, ANGLES), np.clip(high, 0, ANGLES)
            inside = below[at, np.maximum(high, low)] - below[at, low]
            for i, cells in enumerate(had):
                inside[i, cells] = 0
            chosen = [everywhere] * len(angles)
            # Cells that are left out hold no more than ``missed``.
            for i in np.flatnonzero(inside.sum(axis=1) - missed <= MOST_SHARE * total).tolist():
                order = np.argsort(inside[i], kind="stable")
                some = order[np.cumsum(inside[i][order]) > missed]
                if inside[i][some].sum() <= MOST_SHARE * total:
                    chosen[i] = some
            return chosen

        def pairs(vectors: pa.Array, choose: Callable[[np.ndarray, slice], list[np.ndarray]]) -> pa.Array:
            vectors = _matrix(vectors)
            chosen, own = [], []
            for i in range(0, len(vectors), ASKED):
                angles = _angle(vectors[i : i + ASKED] @ centres.T)
                some = choose(angles, slice(i, i + ASKED))
                sizes = [len(c) for c in some]
                # Of no use for EVERYWHERE.
                own.append(angles[np.repeat(np.arange(len(angles)), sizes), np.concatenate(some)])
                chosen += some
            flat = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in chosen])]).astype(np.int32)
            both = [pa.array(flat.astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *own]))]
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays(both, ["cell", "angle"])
            )

        @F.arrow_udf("array<struct<cell: int, angle: double>>")
        def nearest(vectors: pa.Array) -> pa.Array:
            return pairs(vectors, lambda angles, _: first(angles))

        @F.arrow_udf("array<struct<cell: int, angle: double>>")
        def others(vectors: pa.Array, scores: pa.Array, had: pa.Array) -> pa.Array:
            seen = np.split(had.flatten().to_numpy(), np.cumsum(np.diff(had.offsets.to_numpy()))[:-1])
            floors = scores.to_numpy(zero_copy_only=False)
            return pairs(vectors, lambda angles, own: rest(angles, floors[own], seen[own]))

        return nearest, others

    def _partial(self, asked: DataFrame, k: int) -> DataFrame:
        """Best k rows of the cells asked for: ``asked`` is (query_id, embedding, floor, _cell, _theta)."""
        key = ["_cell", *self.attributes]

        def score(corpus: pa.Table, queries: pa.Table) -> pa.Table:
            asked, none = queries.column("query_id").to_numpy(), np.zeros(0, np.int64)
            if not len(corpus):
                return _score_rows(asked[:0], none, none, none, none)
            angles = corpus.column("_angle").to_numpy()
            order = np.argsort(angles, kind="stable")
            angles, ids = angles[order], corpus.column("corpus_id").to_numpy()[order]
            block = _matrix(corpus.column("embedding"))[order]
            vectors = _matrix(queries.column("embedding"))
            floors, thetas = queries.column("floor").to_numpy(), queries.column("_theta").to_numpy()
            reach = _angle(floors - 10.0**-SCORE_DIGITS) + SLACK
            low = np.searchsorted(angles, thetas - reach, "left")
            high = np.searchsorted(angles, thetas + reach, "right")
            # Queries that look at the whole block do so together.
            whole = np.flatnonzero(high - low == len(ids))
            together = dict(zip(whole.tolist(), _nearest(ids, block, vectors[whole], k)))
            found = [(none, none, np.zeros(0))]
            for i, (q, a, b, floor) in enumerate(zip(vectors, low, high, floors)):
                own, scores = together[i] if i in together else _best(ids[a:b], block[a:b] @ q, k)
                better = scores >= floor - 10.0**-SCORE_DIGITS
                found.append((np.full(better.sum(), i), own[better], scores[better]))
            return _score_rows(asked, *(np.concatenate(x) for x in zip(*found)), high - low)

        met = _in_grid(self.rows, asked, key, self.centres.shape[1])
        return met.applyInArrow(score, SCORES_SCHEMA)

    def compare(self, queries: DataFrame, k: int = V.TOP_K, recall: float = 0.95) -> DataFrame:
        """Partial hits of every block looked into, and how many rows were compared there."""
        missed = int((1 - recall) * k + 1e-9)
        names = self.attributes
        asked = _asking(queries.filter(_known(names)), *names)
        if not len(self.centres):
            return asked.sparkSession.createDataFrame([], SCORES_SCHEMA)

        nearest, others = self._probes(k, missed)
        asked = cut_lineage(asked.withColumn("_first", nearest("embedding")), "asked")

        def sent(to: DataFrame, floor: Column, cells: Column) -> DataFrame:
            exploded = to.select("query_id", "embedding", *names, floor.alias("floor"), F.explode(cells).alias("_probe"))
            return exploded.select(
                "query_id", "embedding", "floor", *names,
                F.col("_probe.cell").alias("_cell"), F.col("_probe.angle").alias("_theta"),
            )

        # -2 is below every cosine: all rows of the first cells are compared.
        none = F.lit(-2.0)
        probes = cut_lineage(sent(asked, none, F.col("_first")), "probes")
        first = cut_lineage(self._partial(probes, k), "first")
        in_query = W.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
        floors = (
            first.filter("corpus_id IS NOT NULL")
            .withColumn("_place", F.row_number().over(in_query))
            .filter(F.col("_place") == k)
            .select("query_id", F.col("score").alias("floor"))
        )
        left = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none))
        more = others("embedding", "floor", F.col("_first.cell"))
        probes = cut_lineage(sent(left, F.col("floor"), more), "probes")
        everywhere = F.col("_cell") == EVERYWHERE
        parts = [first]
        if probes.filter(~everywhere).limit(1).count():
            parts.append(self._partial(probes.filter(~everywhere), k))
        if probes.filter(everywhere).limit(1).count():
            # Their first cells come again here; the hits found before only say that this is needed.
            asked = probes.filter(everywhere).select("query_id", "embedding", F.col("floor").alias("_floor"), *names)
            parts[0] = first.join(asked.select("query_id"), "query_id", "left_anti")
            parts.append(block_scores(self.rows, asked, k, names))
        return reduce(DataFrame.unionByName, parts)

    def search(self, queries: DataFrame, k: int = V.TOP_K, recall: float = 0.95) -> DataFrame:
        """(query_id, rank, corpus_id, score): at least ``recall`` of the k nearest rows of each query.

        The share is certain, not expected: cells are left out only as long as all rows in them that could
        be better are fewer than the misses allowed. A query that no bound helps is compared with every row.
        """
        return _ranked(self.compare(queries, k or V.TOP_K, recall), k or V.TOP_K)


def build_cells(
    corpus: DataFrame,
    attributes: list[str] | None = None,
    cells: int | None = None,
    sample: int = SAMPLE_ROWS,
    seed: int = V.SEED,
) -> CellIndex:
    """Rows (corpus_id, embedding, attributes) placed into cells and stored.

    Centres come from at most ``sample`` vectors, as many as the square root of the rows as long as the
    sample has some vectors for each. Rows without words are near to nothing; they lie in the first cell,
    a right angle away. With ``attributes`` a query meets rows that equal it in all of them.
    """
    names = attributes or []
    rows = corpus.filter(_known(names)).select(F.col("corpus_id").cast("bigint"), "embedding", *names)
    rows = cut_lineage(rows, "vectors").filter("embedding IS NOT NULL")
    spoken = rows.filter(F.exists("embedding", lambda x: x != 0))
    n = rows.count()
    # More than half of the share wanted pass by any hash; the rest is cut off in the order of the hash.
    share = F.pmod(F.xxhash64(F.lit(seed), "corpus_id"), F.lit(1 << 30))
    some = spoken if n <= sample else spoken.filter(share < int(2 * sample / n * (1 << 30)))
    drawn = some.select("embedding", share.alias("h")).orderBy("h").limit(sample).toArrow()
    vectors = _matrix(drawn.column("embedding")) if len(drawn) else np.zeros((0, 1))
    wanted = cells or max(1, int(n**0.5))
    centres = vectors
    if len(vectors):
        centres = _fit_centres(vectors, max(1, min(wanted, -(-len(vectors) // SAMPLE_PER_CELL))), seed)
    elif n:  # no row says anything
        centres = np.zeros((1, _width(rows)))

    @F.arrow_udf("struct<_cell: int, _angle: double>")
    def place(column: pa.Array) -> pa.Array:
        cosines = _matrix(column) @ centres.T
        cell = cosines.argmax(axis=1)
        angle = _angle(cosines[np.arange(len(cell)), cell])
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(angle)], ["_cell", "_angle"]
        )

    placed = cut_lineage(rows.withColumn("_at", place("embedding")).select("*", "_at.*").drop("_at"), "cells")
    counts = np.zeros((len(centres), ANGLES), np.int64)
    edge = F.least(F.floor(F.col("_angle") / (np.pi / ANGLES)), F.lit(ANGLES - 1)).alias("edge")
    # One row per cell and bin.
    for r in placed.groupBy("_cell", edge).agg(F.count("*").alias("n")).collect():
        counts[r["_cell"], r["edge"]] = r["n"]
    return CellIndex(placed, centres, counts, names)


def vector_topk_approx(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_K,
    attributes: list[str] | None = None,
    recall: float = 0.95,
    cells: int | None = None,
) -> DataFrame:
    """Top k with at least ``recall`` of the true hits of every query, without comparing all rows.

    See :class:`CellIndex`; keep one where several searches go to the same corpus.
    """
    return build_cells(corpus, attributes, cells).search(queries, k, recall)


def with_cosine(hits: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with the cosine of their own two vectors, computed anew."""

    def dot(a: str, b: str) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

    c = corpus.select(F.col("corpus_id").cast("bigint"), F.col("embedding").alias("_c"))
    q = queries.select(F.col("query_id").cast("bigint"), F.col("embedding").alias("_q"))
    joined = hits.join(c, "corpus_id").join(q, "query_id")
    cosine = dot("_c", "_q") / F.sqrt(dot("_c", "_c") * dot("_q", "_q"))
    return joined.withColumn("cosine", cosine).drop("_c", "_q")


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, by query."""
    found = approx.select("query_id", "corpus_id").withColumn("_hit", F.lit(1))
    return (
        exact.join(found, ["query_id", "corpus_id"], "left")
        .groupBy("query_id")
        .agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"))
    )
