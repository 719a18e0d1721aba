"""Conversations without quotes: quoted passages are linked to the messages they come from.

A line that begins with ``>`` marks is quoted, as deep as it has marks. Neighbouring lines of one
depth are a passage. Passages, and their single lines, are normalised (small letters, letters and
digits only) and looked up among what earlier messages of the conversation wrote themselves: their
passages, their lines and their whole own text. Of several messages with the same passage the latest
earlier one counts. A message answers the one from which it quotes most, at the lowest depth that
matches at all. Messages that quote nothing known begin a thread of their own.

Threads and depths come from pointer doubling, so a chain of n answers takes log2(n) joins. The order
inside a conversation comes from one sort of the whole table; no conversation is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequences import last_before, number_rows
from .common import prepare, staged

MARKS = r"^((?:[ \t]*>)+)"


def normalized(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(id, conv_id, turn, pos, level, line, norm): every line with its quote depth."""
    mark = F.regexp_extract("line", MARKS, 1)
    return (
        messages.select("id", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("_mark", mark)
        .select(
            "id", "conv_id", "turn", "pos",
            F.length(F.regexp_replace("_mark", "[^>]", "")).alias("level"),
            "line",
            normalized(F.substring(F.col("line"), F.length("_mark") + 1, F.length("line"))).alias("norm"),
        )
    )


def _joined(order: str, text: str, separator: str) -> Column:
    """A group's texts in order. A group is part of one message."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(rows, lambda r: r.getField(text)), separator)


def _keys(lines: DataFrame) -> DataFrame:
    """(id, conv_id, turn, level, key, weight): what a message quotes or wrote, distinct."""
    own = ["id", "conv_id", "turn", "level"]
    rank = F.row_number().over(W.partitionBy("id", "level").orderBy("pos"))
    told = lines.withColumn("run", F.col("pos") - rank).filter("norm <> ''")
    passages = told.groupBy(*own, "run").agg(_joined("pos", "norm", " ").alias("norm"))
    whole = told.filter("level = 0").groupBy(*own).agg(_joined("pos", "norm", " ").alias("norm"))
    every = (
        told.select(*own, "norm").unionByName(passages.select(*own, "norm")).unionByName(whole.select(*own, "norm"))
    )
    return every.select(*own, F.sha2("norm", 256).alias("key"), F.length("norm").alias("weight")).distinct()


def _parents(keys: DataFrame) -> DataFrame:
    """(id, parent, parent_turn, links): the message each quoting message answers."""
    quoted = keys.filter("level > 0")
    # One row per conversation, passage and turn on either side; originals stand behind quotes of
    # their own turn, so that only earlier turns are seen.
    originals = (
        keys.filter("level = 0")
        .join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
        .groupBy("conv_id", "key", "turn")
        .agg(F.min("id").alias("source"))
        .select("conv_id", "key", (F.col("turn") * 2 + 1).alias("at"), F.struct("turn", "source").alias("found"))
    )
    asked = quoted.select("conv_id", "key", (F.col("turn") * 2).alias("at")).distinct()
    both = staged(
        originals.unionByName(asked.withColumn("found", F.lit(None).cast("struct<turn:bigint,source:string>"))),
        "passages",
    )
    latest = last_before(both, ["conv_id", "key"], "at", F.col("found"), "origin")
    links = (
        quoted.withColumn("at", F.col("turn") * 2)
        .join(latest.filter("found IS NULL AND origin IS NOT NULL"), ["conv_id", "key", "at"])
        .groupBy("id", "level", F.col("origin.source").alias("parent"), F.col("origin.turn").alias("parent_turn"))
        .agg(F.sum("weight").alias("weight"))
    )
    order = F.struct((-F.col("level")).alias("shallow"), "weight", "parent_turn", "parent")
    return links.groupBy("id").agg(F.max(order).alias("best"), F.count_distinct("parent").alias("links")).select(
        "id", "best.parent", "best.parent_turn", "links"
    )


def _threads(parents: DataFrame) -> DataFrame:
    """(id, top, depth): the first message of the thread and the steps to it, for all that answer."""
    hops = staged(parents.select("id", F.col("parent").alias("top"), F.lit(1).cast("bigint").alias("depth")), "hops")
    while True:
        further = hops.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        joined = staged(hops.join(further, "top", "left"), "hops")
        if not joined.filter("next IS NOT NULL").limit(1).count():
            return joined.select("id", "top", "depth")
        hops = joined.select(
            "id",
            F.coalesce("next", "top").alias("top"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, linked and in reply order.

    Returns conv_id, turn, role, own_text, parent_turn, thread_turn, depth, n_quoted, n_links,
    place. ``place`` counts a conversation from 0: threads by their first turn, inside a thread by
    depth, then by the turn answered and by the own turn, so an answer never stands before what it
    answers. ``n_quoted`` counts quoted lines that say something, ``n_links`` the messages quoted.

    Rows that agree in all four columns count once; several messages of one turn each stay. A null
    text has no own text and quotes nothing. A row without a conversation or a turn is left without
    links and belongs to the conversation ``null``. Other columns are not looked at, and an empty
    table gives no rows.
    """
    prepare(messages.sparkSession)
    columns = ["conv_id", "turn", "role", "text"]
    rows = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    ).withColumn("id", F.sha2(F.to_json(F.struct(*columns)), 256))
    rows = staged(rows.groupBy("id").agg(*[F.first(c).alias(c) for c in columns]), "messages")
    lines = staged(quoted_lines(rows), "lines")
    placed = lines.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = placed.filter("level > 0 AND norm <> ''").select("conv_id").distinct()
    parents = staged(_parents(_keys(placed.join(quoting, "conv_id", "left_semi"))), "parents")
    threads = _threads(parents).join(
        rows.select(F.col("id").alias("top"), F.col("turn").alias("top_turn")), "top"
    )
    own = lines.groupBy("id").agg(
        F.array_join(
            F.transform(
                F.filter(F.array_sort(F.collect_list(F.struct("pos", "level", "line"))), lambda r: r["level"] == 0),
                lambda r: r["line"],
            ),
            "\n",
        ).alias("own_text"),
        F.count_if(F.expr("level > 0 AND norm <> ''")).alias("n_quoted"),
    )
    zero = F.lit(0).cast("bigint")
    linked = (
        rows.select("id", "conv_id", "turn", "role")
        .join(own, "id", "left")
        .join(parents.select("id", "parent_turn", "links"), "id", "left")
        .join(threads.select("id", "top_turn", "depth"), "id", "left")
        .select(
            "id", "conv_id", "turn", "role", "own_text", "parent_turn",
            F.coalesce("top_turn", "turn").alias("thread_turn"),
            F.coalesce("depth", zero).alias("depth"),
            F.coalesce("n_quoted", zero).alias("n_quoted"),
            F.coalesce("links", zero).alias("n_links"),
        )
    )
    order = ["conv_id", "thread_turn", "depth", "parent_turn", "turn", "id"]
    numbered = staged(number_rows(linked, order, "_number", 0), "numbered")
    first = numbered.groupBy("conv_id").agg(F.min("_number").alias("_first"))
    first = first.withColumnRenamed("conv_id", "_conv")
    return (
        numbered.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("place", F.col("_number") - F.col("_first"))
        .drop("id", "_number", "_first", "_conv")
    )
