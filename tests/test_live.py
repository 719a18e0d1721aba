"""Keyed tables, replaced tables and streams."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import retrieval as R
from ticketmill.operators import state as S
from ticketmill.session import scratch_path
from ticketmill.sources import keyed as D
from ticketmill.sources import sinks as K
from ticketmill.sources.readers import load_new_files, stream_parquet
from ticketmill.streaming import tables as L


@pytest.fixture
def database(spark):
    path = scratch_path(spark, "db")
    name = f"db_{path.rsplit('-', 1)[1]}"
    K.ensure_database(spark, name, path)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def day(n, minute=0):
    return dt.datetime(2024, 1, n, 0, minute)


# --- keyed tables


def files(spark, table):
    base = D._facts(spark, table)["base"]
    spark.catalog.refreshTable(base)
    return {r["f"] for r in spark.table(base).select(F.input_file_name().alias("f")).collect()}


def add(old, new):
    one = old.join(new.withColumnRenamed("n", "_n"), "id", "full_outer")
    zero = F.lit(0).cast("bigint")
    return one.select("id", (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"))


def counts(spark, table):
    return {r["id"]: r["n"] for r in D.keyed_table(spark, table).collect()}


@pytest.mark.parametrize("rows,file_rows", [(0, 10), (1, 10), (40, 10), (41, 10), (10**9, 10**6), (10**12, 10**6)])
def test_folders_and_writers_follow_the_size(rows, file_rows):
    folders, buckets = D.shape(rows, file_rows)
    assert folders <= buckets <= 2 * folders
    assert max(4, rows / file_rows) <= folders * buckets < 2 * max(4, rows / file_rows + 1)


def test_upserts_rewrite_only_what_changes(spark, database):
    table = f"{database}.counts"
    D.create_keyed_table(spark.range(4000).withColumn("n", F.lit(1).cast("bigint")), table, ["id"], 16)
    before = files(spark, table)
    assert len(before) >= 200
    changes = spark.createDataFrame([(3, 5), (9999, 7)], "id bigint, n bigint")
    D.replace_keys(table, changes, add)
    assert counts(spark, table) == {**{i: 1 for i in range(4000)}, 3: 6, 9999: 7}
    gone = before - files(spark, table)
    assert len({re.search("_folder=[0-9]+", f)[0] for f in gone}) <= 2
    D.replace_keys(table, changes.limit(0), add)
    assert len(counts(spark, table)) == 4001


def test_many_writers_for_one_folder(spark, database):
    table = f"{database}.wide"
    D.create_keyed_table(spark.range(2000).withColumn("n", F.lit(1).cast("bigint")), table, ["id"], 8)
    by_folder = {}
    for f in files(spark, table):
        by_folder.setdefault(re.search("_folder=([0-9]+)", f)[1], set()).add(re.search("part-([0-9]+)", f)[1])
    assert len(by_folder) == D.shape(2000, 8)[0] and all(len(w) > 8 for w in by_folder.values())


def test_the_tables_side_of_a_merge_is_not_moved(spark, database):
    table = f"{database}.t"
    rows = spark.range(500).withColumn("n", F.lit(1).cast("bigint")).withColumn("at", F.lit(1))
    D.create_keyed_table(rows, table, ["id"], 10)
    for merge in (D.newer(["id"], ["at"]), lambda old, new: old.join(new.select("id"), "id", "left_anti")):
        merged = D.merged_rows(table, rows.limit(3), merge)
        base = D._facts(spark, table)["base"].rpartition(".")[2]
        lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and base in line)
        column = lambda line: len(line) - len(line.lstrip(" :+-*"))
        above, depth = [], column(lines[at])
        for line in reversed(lines[:at]):
            if column(line) < depth:
                above.append(line)
                depth = column(line)
        assert not any("Exchange" in line for line in above) and any("Join" in line for line in above)


def test_an_outgrown_table_gets_another_shape(spark, database):
    table = f"{database}.growing"
    D.create_keyed_table(spark.createDataFrame([], "id bigint, n bigint"), table, ["id"], 5)
    shapes = {int(D._facts(spark, table)["folders"])}
    for batch in range(6):
        changes = spark.range(batch * 300, batch * 300 + (400 if batch else 30)).withColumn("n", F.lit(1).cast("bigint"))
        D.replace_keys(table, changes, add)
        shapes.add(int(D._facts(spark, table)["folders"]))
    assert shapes == {2, 8}
    expected = {i: 1 + (i % 300 < 100 and 600 <= i < 1800) for i in [*range(30), *range(300, 1900)]}
    assert counts(spark, table) == expected


def test_a_row_without_a_key_is_refused_and_the_table_stays(spark, database):
    table = f"{database}.k"
    D.create_keyed_table(spark.range(3).withColumn("n", F.lit(1).cast("bigint")), table, ["id"])
    with pytest.raises(Exception, match="key is null"):
        D.replace_keys(table, spark.createDataFrame([(None, 1)], "id bigint, n bigint"), add)
    with pytest.raises(Exception):
        broken = F.raise_error(F.lit("no")).cast("bigint").alias("id")
        D.replace_keys(table, spark.range(1).withColumn("n", F.lit(1)), lambda old, new: new.select(broken, "n"))
    assert counts(spark, table) == {0: 1, 1: 1, 2: 1}


def test_newer_rows_win(spark, database):
    table, schema = f"{database}.n", "id bigint, at int, value string, created int"
    merge = D.newer(["id"], ["at"], ["created"])
    D.create_keyed_table(spark.createDataFrame([(1, 5, "a", 5), (2, 5, "b", 5), (3, None, "c", None)], schema), table, ["id"])
    late = [(1, 4, "late", 4), (2, 5, None, 6), (3, 1, "d", 1), (4, 1, "e", 1)]
    for _ in range(2):
        D.replace_keys(table, spark.createDataFrame(late, schema), merge)
    found = sorted(map(tuple, D.keyed_table(spark, table).collect()))
    assert found == [(1, 5, "a", 4), (2, 5, None, 5), (3, 1, "d", 1), (4, 1, "e", 1)]


def test_a_failing_write_leaves_the_table(spark, database):
    table = f"{database}.t"
    K.create_table_as(spark, table, "SELECT * FROM {rows}", rows=spark.range(3))
    with pytest.raises(Exception):
        K.create_table_as(spark, table, f"SELECT raise_error('no') FROM {table}")
    assert spark.table(table).count() == 3
    K.create_table_as(spark, table, f"SELECT id + 1 AS id FROM {table}")
    assert sorted(r["id"] for r in spark.table(table).collect()) == [1, 2, 3]
    K.create_table_as(spark, table, f"SELECT id, 'x' AS name FROM {table}")
    assert spark.table(table).columns == ["id", "name"] and spark.table(table).count() == 3
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["t"]


# --- streams


SCHEMA = """conversation_id string, thread_id bigint, last_assistant_message_id bigint,
    origin_application string, updated_at timestamp_ntz, event_id bigint"""


class Deliveries:
    """A folder of files, and the stream over it."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.stage, self.seen = (scratch_path(spark, n) for n in ["stage", "seen"])

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(3).write.mode("append").parquet(self.stage)
        return stream_parquet(self.spark, self.stage, self.schema)


def empty(spark, table, schema, keys):
    D.create_keyed_table(spark.createDataFrame([], schema), table, keys)


def test_upserts_of_conversations_with_a_late_one(spark, database):
    table, order = f"{database}.conversations", ["updated_at", "event_id"]
    empty(spark, table, SCHEMA + ", created_at timestamp_ntz", ["conversation_id"])
    source = Deliveries(spark, SCHEMA)
    for rows in (
        [("a", 1, 10, "x", day(5), 1), ("b", 2, 20, "x", day(5), 2)],
        [("a", 1, None, "y", day(6), 3)],
        [("b", 2, 99, "late", day(1), 0)],
    ):
        L.keep_conversations(source.add(rows), table, order, source.seen)
    columns = ["conversation_id", "thread_id", "last_assistant_message_id", "created_at", "updated_at"]
    live = D.keyed_table(spark, table).orderBy("conversation_id").select(*columns).collect()
    assert [tuple(r) for r in live] == [("a", 1, None, day(5), day(6)), ("b", 2, 20, day(1), day(5))]


def test_files_are_loaded_once(spark):
    stage, table, seen = (scratch_path(spark, n) for n in ["stage", "table", "seen"])
    for _ in range(2):
        spark.range(10).write.mode("append").parquet(stage)
        for _ in range(2):
            load_new_files(stream_parquet(spark, stage, "id bigint"), table, seen)
    assert spark.read.parquet(table).count() == 20


def test_index_stream_embeds_changes_only(spark, database, monkeypatch):
    table = f"{database}.index"
    empty(spark, table, "id bigint, digest string, embedding array<double>", ["id"])
    source = Deliveries(spark, "id bigint, text string, version int")
    embedded = []

    def built(rows, *rest):
        embedded.append(sorted(r["id"] for r in rows.collect()))
        return R.build_search_index(rows, *rest)

    monkeypatch.setattr(L, "build_search_index", built)
    for rows in (
        [(1, "a", 1), (2, "b", 2), (2, "older", 1)],
        [(1, "a", 1), (2, "changed", 3), (3, "new", 1)],
    ):
        L.keep_index_fresh(source.add(rows), table, "id", "text", [], ["version"], source.seen)
    assert embedded == [[1, 2], [2, 3]]
    live = {r["id"]: r["digest"] for r in D.keyed_table(spark, table).collect()}
    want = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "new")], "id bigint, text string")
    assert live == {r["id"]: r["digest"] for r in R.build_search_index(want, "id", "text", []).collect()}


def test_no_message_is_too_late_and_the_newest_snapshot_stays(spark, database):
    table, schema = f"{database}.messages", "thread_id bigint, message_id bigint, ts timestamp_ntz"
    keys = ["thread_id", "message_id"]
    empty(spark, table, schema, keys)
    source = Deliveries(spark, schema)
    for rows in (
        [(1, 1, day(9)), (1, 1, day(8)), (1, 2, day(9))],
        [(1, 3, day(1)), (1, 1, day(2))],
        [(1, 2, day(20)), (1, 3, day(1))],
        [(1, 1, day(3))],
    ):
        L.keep_messages(source.add(rows), keys, ["ts"], table, source.seen)
    found = sorted(map(tuple, D.keyed_table(spark, table).select(*keys, "ts").collect()))
    assert found == [(1, 1, day(9)), (1, 2, day(20)), (1, 3, day(1))]


def state_rows(spark, path):
    """Keys in the state of the last batch."""
    return spark.read.format("statestore").load(path).count()


def test_idle_conversations_leave_the_state_and_are_counted_whole(spark, database):
    table = f"{database}.state"
    empty(spark, table, f"key bigint, {L.STATE}, expired boolean", ["key", "since"])
    source = Deliveries(spark, "conv bigint, turn bigint, role string, arrived timestamp")
    held, expected = [], {}
    for n in range(6):
        # Ten new conversations a day, and one that comes back every other day.
        rows = [(100 * n + c, t, "user" if t % 2 == 0 else "assistant", day(2 + n)) for c in range(10) for t in range(4)]
        if n % 2 == 0:
            rows += [(7777, n, "assistant", day(2 + n)), (7777, 50 - n, "user", day(2 + n))]
        for conv, turn, role, _ in rows:
            last, many = expected.get(conv, (None, 0))
            expected[conv] = (max(last or 0, turn + 1) if role == "assistant" else last, many + 1)
        answer = F.when(F.col("role") == "assistant", F.col("turn") + 1)
        L.keep_last_message(
            source.add(rows), "conv", answer, F.col("turn"), table, source.seen, "arrived", "12 hours"
        )
        held.append(state_rows(spark, source.seen))
    # Those of the day, and of the day before: what is idle leaves with the next delivery.
    assert max(held) <= 22
    found = {r["key"]: (r["last_message_id"], r["n_messages"]) for r in L.last_messages(spark, table).collect()}
    assert found == expected
    states = D.keyed_table(spark, table)
    assert states.filter("key = 7777").count() == 3 and states.filter("NOT expired").count() <= 22


EVENTS = "id bigint, ts timestamp, kind string"


def test_windows_close_once_and_late_rows_are_kept_apart(spark):
    source, root = Deliveries(spark, EVENTS), scratch_path(spark, "windows")

    def ends(batch):
        window = batch.select("*", F.window("ts", "1 day").alias("w"))
        return window.select("*", F.col("w.end").alias("window_end")).drop("w")

    for rows in (
        [(1, day(1), "a"), (2, day(1, 5), "a"), (3, day(3), "b"), (4, day(8), "a")],
        [(5, day(2), "late"), (6, day(7), "in time"), (7, day(10), "a")],
        [(8, day(7, 1), "late"), (9, day(20), "a")],
    ):
        stream = source.add(rows)
        closed = L.activity_windows(stream, "ts", "2 days", ["kind"], "1 day")
        load_new_files(closed, f"{root}/closed", source.seen)
        L.keep_late(stream, "ts", "2 days", ends, f"{root}/behind", f"{source.seen}-late")
    found = sorted((r["window_start"].day, r["kind"], r["n"]) for r in spark.read.parquet(f"{root}/closed").collect())
    assert found == [(1, "a", 2), (3, "b", 1), (7, "in time", 1), (8, "a", 1), (10, "a", 1)]
    assert sorted(r["id"] for r in L.late_rows(spark, f"{root}/behind").collect()) == [5, 8]


def test_a_late_row_makes_one_session_of_two(spark):
    source, table = Deliveries(spark, EVENTS), scratch_path(spark, "sessions")
    for rows in (
        [(1, day(5, 0), "a"), (2, day(5, 50), "a"), (3, day(5, 0), "b"), (4, day(5, 59), "c")],
        [(5, day(5, 25), "a"), (6, day(5, 45), "c")],
        [(7, day(9), "z")],
    ):
        sessions = L.activity_sessions(source.add(rows), "ts", "1 day", ["kind"], "30 minutes")
        load_new_files(sessions, table, source.seen)
    found = sorted(map(tuple, spark.read.parquet(table).collect()))
    assert found == [
        ("a", day(5, 0), dt.datetime(2024, 1, 5, 1, 20), 3),
        ("b", day(5, 0), day(5, 30), 1),
        ("c", day(5, 45), dt.datetime(2024, 1, 5, 1, 29), 2),
    ]


def test_a_large_delivery_finds_buckets_for_its_rows(spark, database):
    table, seen = f"{database}.large", []

    def merge(old, new):
        seen.append(int(D._facts(spark, table)["buckets"]))
        return add(old, new)

    D.create_keyed_table(spark.createDataFrame([(1, 5)], "id bigint, n bigint"), table, ["id"], 5)
    D.replace_keys(table, spark.range(400).withColumn("n", F.lit(1).cast("bigint")), merge)
    assert seen == [D.shape(401, 5)[1]] and seen[0] >= 16
    assert counts(spark, table) == {**{i: 1 for i in range(400)}, 1: 6}
