"""A corpus run: language ID, quality, near duplicates, packing, each stage on what the last kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.llm import langid, minhash, packing, quality
from ticketmill.llm.common import prepare, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose chance of good quality is below this are rejected.
LEAST_QUALITY = 0.3
#: A text of at least JUDGED_LETTERS letters needs this corrected share of n-grams of a learned language.
#: Texts of that length in learned languages have 0.47 or more on the given tables, others 0.04 or less.
LEAST_SHARE, JUDGED_LETTERS = 0.1, 100


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: texts that are null or have no letter, and texts long enough to
    judge of which next to nothing belongs to a learned language, such as other scripts or coded data."""
    filters = langid.learn(docs.select("text", "lang"))
    found = langid.identify(docs, filters)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    known = (F.col("lang_score") >= LEAST_SHARE) | (letters < JUDGED_LETTERS)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & known).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules judge to be poor go."""
    described = quality.with_statistics(docs.select("doc_id", "text")).drop("text")
    model = quality.train(staged(described, "statistics"), table(spark, sf_dir, "labels"))
    scored = quality.with_statistics(docs).filter(model.score() >= LEAST_QUALITY)
    return scored.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows that repeat an id go or stay together; documents without an id cannot be named by one and
    stay.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: doc_id, piece, start, length, sequence_id, offset."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    placed = packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("quality_classifier", good),
    ("minhash_near_dedup", near_dedup),
    ("best_fit_packing", packed),
]

#: Fitted models, hashes and packing are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
