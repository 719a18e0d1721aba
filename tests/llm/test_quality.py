"""The rule ensemble on documents held out from training."""

import numpy as np
import pandas as pd
from llm.plain import auc, odd_documents
from pyspark.sql import functions as F

from ticketmill.llm import quality
from ticketmill.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    result = QUERIES["op3_rule_ensemble_quality"](spark, TABLES).toPandas()
    labels = pd.read_parquet(f"{TABLES}/labels.parquet")
    both = result[result.held_out].merge(labels, on="doc_id")
    assert result.score.between(0, 1).all() and result.doc_id.is_unique
    assert auc(both.score, both.quality) > 0.97
    assert (both[both.quality == 1].predicted == 1).mean() > 0.98
    assert (both[both.quality == 0].predicted == 0).mean() > 0.9


def test_the_expression_agrees_with_the_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] < 0.5)).astype(int)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 200
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"stat_{s}" for s in quality.STATISTICS]))
    got = np.array([r.score for r in df.select(model.score().alias("score")).collect()])
    odds = model.base + sum(w * quality._holds(r, x) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-odds)))
    assert auc(got, y) > 0.99


def test_little_to_learn_from():
    none = np.zeros((0, len(quality.STATISTICS)))
    assert quality.fit(none, np.zeros(0)).rules == []
    one = quality.fit(np.zeros((9, len(quality.STATISTICS))), np.ones(9))
    assert one.rules == [] and one.base > 0
    same = quality.fit(np.zeros((90, len(quality.STATISTICS))), np.arange(90) % 2)
    assert same.rules == []


def test_odd_rows(spark):
    described = quality.with_statistics(odd_documents(spark))
    assert described.columns[:8] == odd_documents(spark).columns
    rows = described.toPandas()
    assert len(rows) == 17 and np.isfinite(rows.filter(like="stat_")).all().all()
    assert (rows[rows.doc_id.isin([0, 1])].filter(like="stat_") == 0).all().all()
    again = quality.with_statistics(described)  # older statistics are replaced
    assert again.columns == described.columns
    empty = odd_documents(spark).filter(F.lit(False))
    assert quality.with_statistics(empty).count() == 0


def test_a_sample_does_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(5)
    names = [f"stat_{s}" for s in quality.STATISTICS]
    x = pd.DataFrame(rng.random((3000, len(names))), columns=names).assign(doc_id=np.arange(3000))
    x = pd.concat([x, x[x.doc_id == 7].sample(1500, replace=True)])  # one row has a third of all copies
    y = pd.DataFrame({"doc_id": np.arange(3000), "quality": (x[names[2]][:3000] > 0.5).astype(int)})
    docs, labels = spark.createDataFrame(x), spark.createDataFrame(y)
    models = [quality.train(docs.repartition(n), labels.repartition(n + 1), 500) for n in (1, 7)]
    assert models[0] == models[1] and models[0].rules
    sample = quality.lowest_hashes(docs, 500).toPandas()
    assert len(sample) == 500 and sample.doc_id.is_unique
    assert quality.lowest_hashes(docs, 5000).count() == 3000


def test_null_and_foreign_labels_are_left_out(spark):
    described = quality.with_statistics(odd_documents(spark).select("doc_id", "text"))
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, quality int")
    assert quality.train(described, labels).rules == []
