"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (
    langid, minhash, negatives, packing, parsing, pieces, pivots, quality, quotes, sharding, spelling,
    urls, vptree,
)
from .common import staged, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, tables: str) -> DataFrame:
            return fn(configure(spark), tables.rstrip("/"))

        QUERIES[key] = run
        if sql is not None:
            CHECKS[key] = sql.strip()
        return run

    return register


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, tables: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, tables, "documents"))


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: who is held out from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


@query("op2_minimax_sharding")
def op2(spark: SparkSession, tables: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, tables, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_rule_ensemble_quality")
def op3(spark: SparkSession, tables: str) -> DataFrame:
    docs = table(spark, tables, "documents").select("doc_id", "text")
    described = staged(quality.with_statistics(docs).drop("text"), "statistics")
    labels = table(spark, tables, "labels").filter(remainder(5) != 0)
    score = quality.train(described, labels).score()
    return described.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op4_boosted_url_filter")
def op4(spark: SparkSession, tables: str) -> DataFrame:
    pages = table(spark, tables, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_chance")


OP5 = r"""
    WITH RECURSIVE lines AS (
        SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM conversations),
    marked AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS mark FROM lines),
    levels AS (
        SELECT conv_id, turn, pos, line, length(regexp_replace(mark, '[^>]', '', 'g')) AS level,
               trim(regexp_replace(lower(substr(line, length(mark) + 1)), '[^\p{L}\p{N}]+', ' ', 'g'))
                   AS norm
        FROM marked),
    runs AS (
        SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run
        FROM levels),
    keys AS (
        SELECT conv_id, turn, level, norm AS key FROM runs WHERE norm <> ''
        UNION
        SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY pos) FROM runs WHERE norm <> ''
        GROUP BY conv_id, turn, level, run
        UNION
        SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY pos) FROM runs
        WHERE norm <> '' AND level = 0 GROUP BY conv_id, turn, level),
    origins AS (
        SELECT q.conv_id, q.turn, q.level, q.key, max(o.turn) AS origin
        FROM keys q JOIN keys o
          ON q.conv_id = o.conv_id AND q.key = o.key AND q.level > 0 AND o.level = 0 AND o.turn < q.turn
        GROUP BY ALL),
    links AS (
        SELECT conv_id, turn, level, origin, sum(length(key)) AS weight FROM origins GROUP BY ALL),
    parents AS (
        SELECT conv_id, turn,
               first(origin ORDER BY level, weight DESC, origin DESC) AS parent_turn,
               count(DISTINCT origin) AS n_links
        FROM links GROUP BY ALL),
    threads AS (
        SELECT c.conv_id, c.turn, c.turn AS thread_turn, 0 AS depth
        FROM conversations c ANTI JOIN parents p ON c.conv_id = p.conv_id AND c.turn = p.turn
        UNION ALL
        SELECT p.conv_id, p.turn, t.thread_turn, t.depth + 1
        FROM threads t JOIN parents p ON p.conv_id = t.conv_id AND p.parent_turn = t.turn),
    own AS (
        SELECT conv_id, turn,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS own_text,
               count(*) FILTER (WHERE level > 0 AND norm <> '') AS n_quoted
        FROM levels GROUP BY ALL)
    SELECT c.conv_id, c.turn, c.role, own.own_text, p.parent_turn, t.thread_turn,
           CAST(t.depth AS BIGINT) AS depth, coalesce(own.n_quoted, 0) AS n_quoted,
           coalesce(p.n_links, 0) AS n_links,
           row_number() OVER (PARTITION BY c.conv_id
                              ORDER BY t.thread_turn, t.depth, p.parent_turn NULLS FIRST, c.turn) - 1
               AS place
    FROM conversations c
    LEFT JOIN own ON c.conv_id = own.conv_id AND c.turn = own.turn
    LEFT JOIN parents p ON c.conv_id = p.conv_id AND c.turn = p.turn
    JOIN threads t ON c.conv_id = t.conv_id AND c.turn = t.turn
"""


@query("op5_quote_linking", OP5)
def op5(spark: SparkSession, tables: str) -> DataFrame:
    return quotes.link_quotes(table(spark, tables, "conversations"))


@query("op6_pivot_permutation_near_dedup")
def op6(spark: SparkSession, tables: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, tables, "embeddings"))


OP7 = """
    WITH usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored AS (
        SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v) AS score
        FROM usable q JOIN usable p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
               AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op7_vantage_point_search", OP7)
def op7(spark: SparkSession, tables: str) -> DataFrame:
    vectors = table(spark, tables, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, factor=1.0)


@query("op8_dominance_best_fit_packing")
def op8(spark: SparkSession, tables: str) -> DataFrame:
    docs = table(spark, tables, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces_ = packing.tokenize(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(staged(pieces_, "pieces"), ["doc_id", "piece", "ids_crc32"])
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op9_bitmask_language_id")
def op9(spark: SparkSession, tables: str) -> DataFrame:
    docs = table(spark, tables, "documents")
    filters = langid.learn(docs.filter(remainder(4) != 2).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), filters).select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@query("op10_sentencepiece_rounds")
def op10(spark: SparkSession, tables: str) -> DataFrame:
    docs = table(spark, tables, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = pieces.encode(docs, path, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


@query("op11_parsing_fingerprints")
def op11(spark: SparkSession, tables: str) -> DataFrame:
    return parsing.fingerprints(table(spark, tables, "documents"))


OP12 = """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
               list_inner_product(a.v, r.v)::BIGINT AS score
        FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
              FROM scored WHERE same) WHERE place <= 5),
    inside AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
                                       ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM positives p JOIN scored s USING (anchor_id)
        WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM inside WHERE rank <= 10
"""


@query("op12_interval_hard_negatives", OP12)
def op12(spark: SparkSession, tables: str) -> DataFrame:
    vectors = table(spark, tables, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_kd_spelling_variants")
def op13(spark: SparkSession, tables: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, tables, "documents")))
