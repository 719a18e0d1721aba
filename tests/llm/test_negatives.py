"""Hard negatives against all pairs in whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest

from ticketmill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, every=10, positives=5, k=10, low=30, high=90, scale=256):
    usable = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        met = [(score(w), i, other) for i, other, w in usable if i != a and len(w) == len(v)]
        met.sort(key=lambda x: (-x[0], x[1]))
        for p, positive, _ in [x for x in met if x[2] == label][:positives]:
            inside = [x for x in met if x[2] != label and low * p <= 100 * x[0] <= high * p]
            out += [(a, positive, n, x[1], p, x[0]) for n, x in enumerate(inside[:k], 1)]
    return sorted(out)


def found(spark, rows, every=10, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(df, df.vec_id % every == 0, **options)
    assert got.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
    return sorted(map(tuple, got.collect()))


def made(n, dim, labels, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels)) if rng.random() > 0.4 else 0  # one label holds much
        v = centres[label] * 0.5 + rng.normal(size=dim) * spread
        rows.append((i, label, (v / np.linalg.norm(v)).tolist()))
    return rows


@pytest.mark.parametrize("dim,labels", [(8, 3), (64, 10), (100, 2)])
def test_equal_to_all_pairs(spark, monkeypatch, dim, labels):
    monkeypatch.setattr(negatives, "SHARD_BYTES", dim * 8 * 90)
    monkeypatch.setattr(negatives, "STRIPE_BYTES", dim * 8 * 17)
    monkeypatch.setattr(negatives, "COPIES", 2)
    rows = made(900, dim, labels, dim)
    rows += [(1000 + k, 1, rows[5][2]) for k in range(120)]  # ties
    assert found(spark, rows) == plain(rows)


def test_other_bands_and_counts(spark):
    rows = made(400, 16, 3, 9)
    options = {"positives": 2, "low": -50, "high": 110}
    expected = plain(rows, 20, 2, 3, -50, 110, 1000)
    assert found(spark, rows, 20, negatives=3, scale=1000, **options) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.25]), (2, 2, [0.4, 0.0]), (3, 2, [0.3, 9.0]), (4, None, [0.4, 0.0]),
        (5, 2, None), (6, 2, []), (7, 2, [None, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]),
        (None, 2, [0.4, 0.0]), (10, 2, [0.0, 0.0]), (11, 2, [0.4, 0.0, 0.0]), (20, 3, [-1.0, 0.0]),
        (21, 3, [0.1, 0.0]), (30, 4, [1.0]),
    ]
    expected = plain(rows)
    assert expected and found(spark, rows) == expected
    assert found(spark, []) == []
    clash = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", dim string, rank int")
    assert negatives.hard_negatives(clash, clash.vec_id % 10 == 0).count() == len(expected)


def test_repeated_rows_are_never_positives_of_themselves(spark):
    rows = [(0, 1, [1.0, 0.0])] * 3 + [(1, 1, [0.9, 0.0]), (2, 2, [0.5, 0.0])]
    got = found(spark, rows)
    assert got == [(0, 1, 1, 2, 58880, 32768)] * 3


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 6)]) for i in range(120)]
    rows.append((200, 1, [float(1 << 40)] * 6))  # too large, takes no part
    assert found(spark, rows) == plain(rows[:-1])


def test_intervals_hold_and_rule_out_most_rows():
    rng = np.random.default_rng(7)
    whole = np.floor(256 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(4000, 64))))
    whole = whole.astype(np.int64)
    codes, aligned, rest = negatives.encode(whole)
    label = np.arange(4000) % 10
    shard = {"ids": np.arange(4000), "labels": [str(x) for x in range(10)], "label": label,
             "whole": whole, "codes": codes, "aligned": aligned, "rest": rest}
    stripe = {k: v[:60] if isinstance(v, np.ndarray) else v for k, v in shard.items()}
    block = negatives.Block(stripe, shard)
    exact = whole[:60] @ whole.T
    for some, rows, middle, half in block.parts():
        assert (np.abs(exact[some, rows] - middle) <= half).all()
    best = block.positives(5)
    other = np.where((label[:60, None] == label) & (np.arange(60)[:, None] != np.arange(4000)), exact, -(1 << 40))
    top = np.sort(other, axis=1)[:, ::-1][:, :5]
    got = defaultdict(list)
    for a, s in zip(best.slot.tolist(), best.score.tolist()):
        got[a].append(s)
    assert [got[a] for a in range(60)] == top.tolist()
    seen = block.scored
    high = (top[:, :1] * 90) // 100
    block.negatives(np.full_like(high, 0), high, 10)
    assert seen < 0.4 * 60 * 400 and block.scored - seen < 0.25 * 60 * 3600, (seen, block.scored)
