"""Vantage-point trees against all inner products."""

import numpy as np
import pytest

from ticketmill.llm import vptree

SCHEMA = "vec_id long, embedding array<float>"


def plain(ids, points, query_ids, queries, k):
    score = vptree.products(queries, points)
    out = []
    for q, row in zip(query_ids, score):
        order = [i for i in np.lexsort((ids, -row)) if ids[i] != q][:k]
        out.append([(int(ids[i]), float(row[i])) for i in order])
    return out


def searched(tree, query_ids, queries, k, factor=1.0):
    row, ids, score = tree.search(query_ids, queries, k, factor)
    out = [[] for _ in query_ids]
    for r, i, s in sorted(zip(row.tolist(), ids.tolist(), score.tolist()), key=lambda x: (x[0], -x[2], x[1])):
        out[r].append((i, s))
    return out


@pytest.mark.parametrize("dim,unit", [(3, True), (16, False), (64, True)])
def test_factor_one_is_exact(dim, unit):
    rng = np.random.default_rng(dim)
    points = rng.normal(size=(900, dim))
    points /= np.linalg.norm(points, axis=1, keepdims=True) if unit else 1
    points[50:90] = points[50]  # ties
    ids = rng.permutation(5000)[:900]
    tree = vptree.Tree(ids, points, leaf=16)
    got = searched(tree, ids[:60], points[:60], 7)
    assert got == plain(ids, points, ids[:60], points[:60], 7)


def test_smaller_factors_visit_less_and_keep_most():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.3
    ids = np.arange(4000)
    tree = vptree.Tree(ids, points, leaf=16)
    seen = []
    scan = tree._scan
    tree._scan = lambda part, rows: (seen.append(len(part) * len(rows)), scan(part, rows))
    exact = searched(tree, ids[:100], points[:100], 10)
    whole = sum(seen)
    seen.clear()
    less = searched(tree, ids[:100], points[:100], 10, factor=0.85)
    hits = sum(len(set(a) & set(b)) for a, b in zip(exact, less))
    assert sum(seen) < whole < 100 * 4000 and hits >= 0.9 * 1000


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(9)
    points = rng.normal(size=(600, 12)).astype(np.float32)
    points[100:400] = points[100]  # half of the rows are one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(vptree.nearest(df, df.filter("vec_id % 5 = 0"), k=6))
    ids = np.arange(600)
    asked = ids[ids % 5 == 0]
    expected = plain(ids, points.astype(float), asked, points[asked].astype(float), 6)
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == dict(zip(asked.tolist(), expected))
    assert all([p for p, _, _ in v] == list(range(1, 7)) for v in got.values())


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]),
        (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]),
        (9, [-1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (40, [0.0, 0.0]), (60, [1.0]),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", rank int, score string")
    got = found(vptree.nearest(df, df.filter("vec_id % 20 = 0"), k=3))
    assert got == {
        0: [(1, 1, 1.0), (2, 20, 0.5), (3, 9, -1.0)],
        20: [(1, 0, 0.5), (2, 1, 0.5), (3, 9, -0.5)],
    }
    empty = spark.createDataFrame([], SCHEMA)
    assert vptree.nearest(empty, empty).count() == 0
