"""Shards against a plain minimax partition."""

import hashlib
import random
import zlib

import pytest
from llm.plain import documents, odd_documents

from ticketmill.llm import sharding


def smallest_capacity(sizes: list[int], shards: int) -> int:
    def needed(capacity):
        n, room = 0, -1
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
                if s > capacity:
                    return len(sizes) + shards
            room -= s
        return n

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def check(texts: dict, result, shards: int) -> None:
    groups = {}
    for t in texts.values():
        key = hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 8
    loads = result.groupby("shard")["size"].sum()
    assert loads.max() == smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert result.shard.between(0, shards - 1).all()
    slots = result.groupby("shard").slot.apply(sorted)
    assert all(s == list(range(len(s))) for s in slots)
    where = result.assign(text=result.doc_id.map(texts).fillna("(null)"))
    assert (where.groupby("text").shard.nunique() == 1).all()
    for i, t in texts.items():
        row = result[result.doc_id == i].iloc[0]
        assert row["size"] == len((t or "").encode()) + 8
        assert t is None or row.text_crc32 == zlib.crc32(t.encode())


def shard(spark, texts: dict, shards: int = 24):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sharding.shard_by_bytes(df, shards).toPandas()


def test_all_documents(spark):
    docs = documents()
    texts = dict(zip(docs.doc_id, docs.text))
    result = shard(spark, texts)
    check(texts, result, 24)
    loads = result.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.min() > 0.85 * loads.mean()


@pytest.mark.parametrize("seed", range(3))
def test_random_sizes(spark, seed):
    rng = random.Random(seed)
    texts = {i: "x" * rng.choice([0, 1, 5, 300, 2000]) + str(rng.randrange(40)) for i in range(150)}
    check(texts, shard(spark, texts, 7), 7)


def test_a_hot_group_leaves_the_other_shards_even(spark):
    texts = {i: "hot text " * 20 for i in range(300)}
    texts |= {i: f"text number {i} " * 12 for i in range(300, 900)}
    result = shard(spark, texts)
    check(texts, result, 24)
    loads = result.groupby("shard")["size"].sum().sort_values()
    assert len(loads) == 24 and loads.iloc[:-1].max() < 1.6 * loads.iloc[:-1].mean()


def test_fewer_groups_than_shards(spark):
    texts = {1: None, 2: "", 3: None, 4: "a"}
    result = shard(spark, texts)
    check(texts, result, 24)
    assert result[result.doc_id.isin([1, 3])].shard.nunique() == 1


def test_odd_rows(spark):
    result = sharding.shard_by_bytes(odd_documents(spark)).toPandas()
    assert len(result) == 17
    slots = result.groupby("shard").slot.apply(sorted)
    assert all(s == list(range(len(s))) for s in slots)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_bytes(empty).count() == 0


def test_no_python_on_the_rows(spark):
    df = sharding.shard_by_bytes(spark.createDataFrame(documents()))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
