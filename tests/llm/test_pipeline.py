"""The pipeline stage by stage, and its queries as the driver runs them."""

import re

import corpus_pipeline as P
import pytest
from compare import differences, duck
from llm.plain import TABLES, documents, near_components, odd_documents

from ticketmill.llm.queries import CHECKS, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and gave, as frames."""
    docs, out = spark.read.parquet(f"{TABLES}/documents.parquet"), {}
    for name, stage in P.STAGES:
        result = P.staged(stage(spark, docs, TABLES), name)
        out[name] = (docs.toPandas(), result.toPandas())
        docs = result
    return out


def test_all_but_the_last_return_documents(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert list(after.columns) == COLUMNS and len(after), name


def test_language_rejects_texts_without_letters(stages):
    before, after = stages["language_id"]
    kept = {i for i, t in zip(before.doc_id, before.text) if t and re.search(r"[^\W\d_]", t)}
    assert set(after.doc_id) == kept


def test_language_rejects_scripts_and_codes_it_has_not_learned(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    russian = "сегодня утром мы идем в магазин за хлебом и молоком "
    strange = [
        russian * 4, "今天我们去商店买面包和牛奶" * 9, "qzx wvk jjq xzz kqv vvq " * 12,
        "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ" * 20, russian * 5000,
    ]
    short = ["αβγ", russian, "zzq"]  # too short to judge: they stay
    rows = [(-1 - i, t, None, "planted", len(t)) for i, t in enumerate(strange + short)]
    planted = spark.createDataFrame(rows, docs.schema)
    kept = P.identified(spark, docs.unionByName(planted), TABLES).select("doc_id").toPandas().doc_id
    assert {i for i in kept if i < 0} == {-6, -7, -8}
    assert (kept >= 0).sum() == docs.filter(r"text RLIKE '\\p{L}'").count()


def test_quality_keeps_good_and_rejects_poor(stages):
    import pandas as pd

    before, after = stages["quality_classifier"]
    labels = pd.read_parquet(f"{TABLES}/labels.parquet")
    labels = labels[labels.doc_id.isin(before.doc_id)]
    kept = labels.doc_id.isin(after.doc_id)
    assert kept[labels.quality == 1].mean() > 0.97 and kept[labels.quality == 0].mean() < 0.15
    assert set(after.doc_id) <= set(before.doc_id)


def test_one_document_of_each_family_stays(stages):
    before, after = stages["minhash_near_dedup"]
    component = near_components(dict(zip(before.doc_id, before.text)))
    assert set(after.doc_id) == {i for i, c in component.items() if i == c}
    texts = dict(zip(before.doc_id, before.text))
    assert all(texts[i] == t for i, t in zip(after.doc_id, after.text))


def test_every_kept_document_is_packed(stages):
    before, after = stages["best_fit_packing"]
    assert set(after.doc_id) == set(before.doc_id)
    for _, s in after.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_run_is_the_stages_in_order(spark, stages):
    got = P.run(spark, TABLES).toPandas()
    _, last = stages["best_fit_packing"]
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(got[key].itertuples(index=False)) == sorted(last[key].itertuples(index=False))


def test_odd_rows_pass_all_stages(spark):
    docs = odd_documents(spark)
    for _, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = P.staged(stage(spark, docs, TABLES), "odd")
        assert docs.columns == columns
    assert P.STAGES[-1][1](spark, docs, TABLES).count() >= docs.count()
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, TABLES).count() == 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_queries_as_registered(spark, key):
    small = "/root/testdata/sf0.001"
    df = QUERIES[key](spark, small)
    if key in CHECKS:
        assert differences(df, CHECKS[key], duck(small)) == []
    else:
        n = df.count()
        assert n == {"op4": 50, "op6": 500}.get(key[:3], 200) or key.startswith("op8") and n > 200
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_documents_fixture_matches_the_table(spark):
    assert spark.read.parquet(f"{TABLES}/documents.parquet").count() == len(documents())
