"""Near-duplicate vectors against all pairs."""

import numpy as np
import pandas as pd
from llm.plain import components

from ticketmill.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    keyed = {}
    for i, v, label in rows:
        v = None if v is None else np.array([np.nan if x is None else x for x in v], np.float32).astype(float)
        ok = v is not None and len(v) and np.isfinite(v).all() and v.any() and label is not None
        keyed[i] = (v if ok else None, label)
    links, edges = dict.fromkeys(keyed, 0), []
    for i, (v, a) in keyed.items():
        for j, (w, b) in keyed.items():
            if i < j and v is not None and w is not None and a == b and len(v) == len(w):
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    edges.append((i, j))
    return links, components(keyed, edges)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return pivots.near_duplicates(df).toPandas().set_index("vec_id")


def families(rng, n, size, dim=32, spread=0.13):
    """Vectors around centres; the spread puts pairs on both sides of the threshold."""
    rows = []
    for k in range(n):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rng.normal(size=dim) * spread * rng.random() / np.sqrt(dim)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], k % 3))
    return rows


def test_families_around_the_threshold(spark):
    rows = families(np.random.default_rng(5), 60, 8)
    links, component = plain(rows)
    got = found(spark, rows).sort_index()
    linked = sum(links.values())
    assert linked > 1000 and 0.97 * linked <= got.n_links.sum() <= linked
    assert (got.n_links <= pd.Series(links)).all()
    assert (got.component_id == pd.Series(component)).mean() > 0.98


def test_all_vectors(spark):
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(int(i), [float(x) for x in v], int(c)) for i, v, c in table.itertuples(index=False)]
    rng = np.random.default_rng(6)
    for k in range(300):  # near copies, far enough to be different vectors
        i, v, c = rows[k]
        near = np.array(v) + rng.normal(size=len(v)) * 0.1 / np.sqrt(len(v))
        rows.append((10_000 + k, [float(x) for x in near.astype(np.float32)], c))
    links, component = plain(rows[:300] + rows[-300:])
    got = found(spark, rows)
    expected = sum(links.values())
    assert expected > 400 and got.n_links.sum() >= 0.98 * expected


def test_hot_copies_and_large_lists(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PART_ROWS", 16)
    rng = np.random.default_rng(7)
    rows = families(rng, 2, 120, spread=0.06)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(150)]
    links, component = plain(rows)
    got = found(spark, rows)
    assert got.n_links.to_dict() == links and got.component_id.to_dict() == component


def test_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1),
        (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1),
        (10, [1.0, 2.0], 2), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 1),
    ]
    links, component = plain(rows)
    got = found(spark, rows)
    assert got.n_links.to_dict() == links and got.component_id.to_dict() == component
    assert (got.kept == (got.component_id == got.index)).all()
    extra = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", node int, key string")
    assert pivots.near_duplicates(extra).count() == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert pivots.near_duplicates(empty).count() == 0
