"""Quote linking: own conversations, the checking SQL, long chains, odd rows."""

import random

import duckdb
from compare import differences

from ticketmill.llm import quotes
from ticketmill.llm.queries import CHECKS

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))


def against_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert differences(linked(spark, rows), CHECKS["op5_quote_linking"], con) == []


def random_conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        own: list[list[str]] = []
        for turn in range(rng.randrange(1, 12)):
            lines = []
            for _ in range(rng.randrange(3)):
                source = rng.choice(own) if own else ["nothing known"]
                depth = rng.choice([1, 1, 1, 2, 3])
                for line in source[: rng.randrange(1, len(source) + 1)]:
                    lines.append(rng.choice(["> ", ">", " > "]) * depth + rng.choice([line, line.upper()]))
                if rng.random() < 0.5:
                    lines.append("")
            said = [f"Line {rng.randrange(30)}, said so." for _ in range(rng.randrange(1, 4))]
            own.append(said)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(lines + said)))
    return rows


def test_random_conversations_agree_with_sql(spark):
    for seed in range(3):
        against_sql(spark, random_conversations(seed))


def test_nested_quotes_and_wrapped_lines(spark):
    rows = [
        (1, 0, "user", "The printer is broken again.\nCan you help?"),
        (1, 1, "assistant", "> The printer is\n> broken again.\nSince when?"),
        (1, 2, "user", ">> The printer is broken again.\n> Since when?\nToday."),
        (1, 3, "user", "Something else."),
        (1, 4, "assistant", "> can you HELP\nYes."),
    ]
    got = {r.turn: r for r in linked(spark, rows).collect()}
    assert [got[t].parent_turn for t in range(5)] == [None, 0, 1, None, 0]
    assert [got[t].depth for t in range(5)] == [0, 1, 2, 0, 1]
    assert [got[t].place for t in range(5)] == [0, 1, 3, 4, 2]
    assert got[2].own_text == "Today." and got[2].n_links == 2


def test_a_long_chain_and_a_hot_first_turn(spark):
    chain = [(1, 0, "user", "start 0")] + [
        (1, t, "user", f"> start {t - 1}\nstart {t}") for t in range(1, 300)
    ]
    hot = [(2, 0, "user", "the first")] + [(2, t, "user", f"> the first\nok {t}") for t in range(1, 500)]
    got = linked(spark, chain + hot).toPandas()
    one = got[got.conv_id == 1].sort_values("turn")
    assert one.depth.tolist() == list(range(300)) and one.place.tolist() == list(range(300))
    two = got[got.conv_id == 2]
    assert (two.parent_turn.dropna() == 0).all() and two.depth.max() == 1 and two.place.max() == 499


def test_a_quote_of_a_later_message_is_no_answer(spark):
    rows = [(1, 0, "u", "> comes later"), (1, 1, "u", "comes later"), (1, 1, "u", "> comes later")]
    assert [r.parent_turn for r in linked(spark, rows).collect()] == [None, None, None]


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "> a"), (1, None, "u", "a"), (1, 0, None, None), (1, 0, "u", ""), (1, 0, "u", ""),
        (1, 1, "u", ">"), (1, 2, "u", "> > >\n>"), (1, 3, "u", "long " * 50_000), (1, 4, "u", "> " + "long " * 50_000),
    ]
    got = linked(spark, rows).toPandas()
    assert len(got) == 8  # the repeated row counts once
    assert got[got.turn == 4].parent_turn.tolist() == [3]
    assert linked(spark, rows[:0]).count() == 0
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", place int, depth int")
    assert quotes.link_quotes(extra).count() == 8
