"""The table function, and profiles from sketches."""

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import inference as I
from ticketmill.operators import profile as P
from ticketmill.session import scratch_path


def logged_client(folder):
    """Every call leaves a file with the number of its texts; a text with 'bad' makes a call fail."""

    def make():
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)

        def answer(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            if any("bad" in t for t in texts):
                raise RuntimeError("no answer")
            return [t.upper() for t in texts]

        return answer

    return make


def calls(folder):
    import glob

    return sorted(int(open(f).read()) for f in glob.glob(f"{folder}/*"))


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "calls").removeprefix("file:")


def test_the_table_function_asks_in_batches_and_keeps_every_row(spark, folder):
    rows = [(i, None if i == 3 else f"text {i}", i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "id int, body string, part int")
    I.register_agent_function(spark, "asked", logged_client(folder), batch_size=30)
    found = spark.sql("SELECT * FROM asked(TABLE({t}) PARTITION BY (part), 'body')", t=table).collect()
    assert len(calls(folder)) == 8 and sum(calls(folder)) == 199 and max(calls(folder)) == 30
    assert {r["id"]: r["response"] for r in found} == {i: b and b.upper() for i, b, _ in rows}
    assert all(r["error"] is None for r in found) and found[0].__fields__ == ["id", "body", "part", "response", "error"]


def test_a_failing_text_keeps_its_row_with_the_error(spark, folder):
    table = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, body string")
    I.register_agent_function(spark, "failing", logged_client(folder), retries=2)
    query = "SELECT * FROM failing(TABLE({t}) PARTITION BY (1), 'body')"
    found = [tuple(r)[2:] for r in sorted(spark.sql(query, t=table).collect(), key=lambda r: r["id"])]
    assert found == [("GOOD", None), (None, "RuntimeError: no answer"), ("FINE", None)]
    assert calls(folder) == [1, 1, 1, 3, 3]
    with pytest.raises(Exception, match="name of its text column"):
        spark.sql("SELECT * FROM failing(TABLE({t}) PARTITION BY (1), 'nothing')", t=table).collect()
    assert spark.sql(query, t=table.limit(0)).count() == 0


def test_profiles_merge_loads_without_reading_texts(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 != 0, F.format_string("v%d", F.col("id") % 5000)).alias("a"),
        F.repeat(F.lit("x"), (F.col("id") % 100).cast("int")).alias("b"),
        F.lit(None).cast("string").alias("c"),
    )
    loads = [P.sketch_load(df.filter(F.rand(1) < 2).limit(n), ["a", "b", "c"]) for n in (30_000, 10_000)]
    merged = P.profile_from_sketches(loads[0].unionByName(loads[1]))
    found = {r["column"]: r for r in merged.collect()}
    assert found["a"]["n"] == 40_000 and found["a"]["nulls"] == 4000
    assert abs(found["a"]["distinct"] - 4500) < 0.05 * 4500
    assert (found["b"]["shortest"], found["b"]["longest"]) == (0, 99) and abs(found["b"]["median"] - 49.5) < 4
    assert found["c"]["nulls"] == 40_000 and found["c"]["median"] is None and found["c"]["distinct"] == 0
