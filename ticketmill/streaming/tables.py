"""Live tables: messages, conversations, conversation state, search index, windows and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.curate import text_digest
from ..operators.retrieval import build_search_index
from ..operators.state import latest_per_key
from ..sources.keyed import keyed_table, newer, replace_keys


def run_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    closing: bool = True,
) -> None:
    """Feed everything the source has now to ``handle`` in micro-batches, then stop.

    Without ``closing`` there is no last batch without rows; state that has run out by then goes with the
    next delivery.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(closing).lower())
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(key, before)
    query.awaitTermination()


def keep_messages(
    stream: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, delay: str = "1 hour"
) -> None:
    """The newest snapshot of every message in a keyed table, whatever the time in it.

    What comes again within ``delay`` of its arrival is dropped by streaming state, which forgets it
    after that; what comes again later meets the table, where the newer snapshot stays. The watermark is
    on the time of arrival, so nothing is too late.
    """
    arriving = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    fresh = arriving.dropDuplicatesWithinWatermark([*keys, *order]).drop("_arrived")

    def save(batch: DataFrame, batch_id: int) -> None:
        replace_keys(table, latest_per_key(batch, keys, order), newer(keys, order))

    run_available(fresh, save, checkpoint, closing=False)


def keep_conversations(stream: DataFrame, table: str, order: list[str], checkpoint: str) -> None:
    """The last update of every conversation by ``order`` in a keyed table.

    ``created_at`` is the first time that a conversation was seen.
    """
    merge = newer(["conversation_id"], order, ["created_at"])

    def save(batch: DataFrame, batch_id: int) -> None:
        replace_keys(
            table, latest_per_key(batch, "conversation_id", order, {"created_at": "updated_at"}), merge
        )

    run_available(stream, save, checkpoint)


STATE = "since bigint, last_message_id bigint, at bigint, n_messages bigint"


#: Stands for no message in the state, where all columns are whole numbers.
NONE = -1


def _last_message(idle_ms: int) -> Callable:
    """Last message and number of rows of a key since it was last idle, until it is idle again."""
    names = ["key", "since", "last_message_id", "at", "n_messages", "expired"]

    def row(key: tuple, state: tuple, expired: bool) -> pd.DataFrame:
        return pd.DataFrame(np.array([[key[0], *state[:4], expired]], np.int64), columns=names)

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(key, state.get, True)
            state.remove()
            return
        since, last, at, n, seen = state.get if state.exists else (None, NONE, NONE, 0, 0)
        for part in rows:
            arrived = part["arrived"].to_numpy()
            if since is not None and arrived.min() >= seen + idle_ms:  # idle until now
                yield row(key, (since, last, at, n), True)
                since, last, at, n = None, NONE, NONE, 0
            since = int(arrived.min()) if since is None else since
            seen, n = max(seen, int(arrived.max())), n + len(part)
            places = part["place"].to_numpy()
            best = int(places.argmax())
            if places[best] > at:
                last, at = int(part["value"].to_numpy()[best]), int(places[best])
        state.update((since, last, at, n, seen))
        state.setTimeoutTimestamp(seen + idle_ms)
        yield row(key, (since, last, at, n), False)

    return update


def conversation_state(
    stream: DataFrame, key: str, value: Column, place: Column, arrived: str, idle: str
) -> DataFrame:
    """(key, since, last_message_id, at, n_messages, expired) as a stream of state changes.

    ``last_message_id`` is the non-null ``value`` at the highest ``place``, a number from 0. A key that has been idle for
    ``idle``, by the watermark on ``arrived``, gives a last row that says so, and its state is dropped;
    rows that come later begin a new state with another ``since``. So the state holds only the keys that
    are being talked about. It goes to Python and back in Arrow batches, with the rows.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    said = F.coalesce(F.when(value.isNotNull(), place), F.lit(NONE))
    rows = stream.withWatermark(arrived, "0 seconds").select(
        F.col(key).cast("bigint").alias("key"),
        F.coalesce(value, F.lit(NONE)).cast("bigint").alias("value"),
        said.cast("bigint").alias("place"),
        F.unix_millis(arrived).alias("arrived"),
        F.col(arrived).alias("_time"),
    )
    states = rows.groupBy("key").applyInPandasWithState(
        _last_message(idle_ms), f"key bigint, {STATE}, expired bigint", f"{STATE}, seen bigint",
        "update", "EventTimeTimeout",
    )
    heard = F.col("at") != NONE
    return states.select(
        "key", "since", F.when(heard, F.col("last_message_id")).alias("last_message_id"),
        F.when(heard, F.col("at")).alias("at"), "n_messages", (F.col("expired") > 0).alias("expired"),
    )


def keep_last_message(
    stream: DataFrame, key: str, value: Column, place: Column, table: str, checkpoint: str,
    arrived: str | None = None, idle: str = "1 day",
) -> None:
    """The states of :func:`conversation_state` in a table keyed by (key, since).

    ``arrived`` is a time column that never goes back; without one it is the time of the batch.
    :func:`last_messages` adds up the states of a key.
    """
    if arrived is None:
        arrived, stream = "_arrived", stream.withColumn("_arrived", F.current_timestamp())
    states = conversation_state(stream, key, value, place, arrived, idle)
    merge = newer(["key", "since"], ["n_messages", "expired"])

    def save(batch: DataFrame, batch_id: int) -> None:
        replace_keys(table, latest_per_key(batch, ["key", "since"], ["n_messages", "expired"]), merge)

    run_available(states, save, checkpoint, "update", closing=False)


def last_messages(spark: SparkSession, table: str) -> DataFrame:
    """Last message and number of rows per key, over all its states."""
    return keyed_table(spark, table).groupBy("key").agg(
        F.max_by("last_message_id", "at").alias("last_message_id"),
        F.sum("n_messages").alias("n_messages"),
    )


def keep_index_fresh(
    stream: DataFrame,
    table: str,
    id_column: str,
    text: str,
    attributes: list[str],
    order: list[str],
    checkpoint: str,
) -> None:
    """Embed the texts of each micro-batch that are new or differ from their entry in a keyed table.

    Of several rows of an id in a batch the last by ``order`` counts; across batches the later
    batch does.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        latest = latest_per_key(batch, id_column, order).withColumn("digest", text_digest(text))
        entries = keyed_table(batch.sparkSession, table).select(id_column, F.col("digest").alias("_old"))
        # The table is bucketed by the id: only the batch is moved.
        joined = latest.join(entries, id_column, "left")
        changed = joined.filter(~F.col("digest").eqNullSafe(F.col("_old"))).drop("_old", "digest")
        replace_keys(
            table, build_search_index(changed, id_column, text, attributes), newer([id_column], [])
        )

    run_available(stream, save, checkpoint)


def activity_windows(
    stream: DataFrame, time: str, delay: str, by: list[str], length: str, slide: str | None = None
) -> DataFrame:
    """(window_start, window_end, by, n): rows per window of event time, sliding ones with ``slide``.

    A window is given once, when the watermark (the highest time of the batches before, less ``delay``)
    has passed its end. Rows that come for it later are not in it; see :func:`keep_late`.
    """
    window = F.window(time, length, slide or length)
    counted = stream.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"
    )


def activity_sessions(stream: DataFrame, time: str, delay: str, by: list[str], gap: str) -> DataFrame:
    """(by, session_start, session_end, n): rows of a key that follow one another within ``gap``.

    Sessions in the state merge when a row comes that lies between them. One is given once, when the
    watermark has passed its end, which is ``gap`` after its last row.
    """
    counted = (
        stream.withWatermark(time, delay)
        .groupBy(*by, F.session_window(time, gap).alias("s"))
        .agg(F.count("*").alias("n"))
    )
    return counted.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def keep_late(
    stream: DataFrame, time: str, delay: str, ends: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> None:
    """Rows that came too late for their window, in a table of their own at ``path``.

    ``ends(rows)`` gives the rows with the ``window_end`` of each window they belong to; a row is late
    for those that the watermark of the batches before had passed. The highest time so far is kept beside
    the rows, per batch. This query sees the deliveries that the one with the windows sees if both are
    run for each of them.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = batch.agg(F.max(time).alias("top")).first()[0]
        if batch_id:
            mark = spark.read.parquet(f"{path}/marks/batch={batch_id - 1}")
            passed = mark.select((F.date_trunc("millisecond", "top") - F.expr(f"INTERVAL {delay}")).alias("passed"))
            late = ends(batch).filter(F.col("window_end") <= passed.scalar())
        else:
            mark = spark.createDataFrame([(None,)], "top timestamp")
            late = ends(batch).limit(0)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        highest = F.greatest("top", F.lit(top).cast("timestamp")).alias("top")
        mark.select(highest).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    run_available(stream, save, checkpoint)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch")
