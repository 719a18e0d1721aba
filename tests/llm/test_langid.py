"""Language filters on documents held out from training."""

import numpy as np
import pandas as pd
from llm.plain import odd_documents
from pyspark.sql import functions as F

from ticketmill.llm import langid
from ticketmill.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    result = QUERIES["op9_bitmask_language_id"](spark, TABLES).toPandas()
    docs = pd.read_parquet(f"{TABLES}/documents.parquet")
    held = result[result.held_out].merge(docs, on="doc_id")
    assert len(result) == len(docs) and result.score.between(0, 1).all()
    assert (held.lang_pred == held.lang).mean() > 0.99


def test_no_gram_is_missed_and_few_are_made_up():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03}": rng.integers(0, 1 << 32, 3000, dtype=np.uint32) for i in range(70)}
    filters = langid.Filters(grams, dict.fromkeys(grams, 1))
    for i in (0, 5, 63, 64, 69):
        own = filters.masks(grams[f"l{i:03}"])
        assert ((own[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    strange = filters.masks(rng.integers(0, 1 << 32, 20_000, dtype=np.uint32))
    rate = [((strange[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(70)]
    assert np.abs(np.array(rate) - filters.chance).max() < 0.01


def test_more_languages_than_a_group(spark):
    """A language per row; n-grams of one group are collected at a time and nothing is left out."""
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    rows = [(f"{word(i)}q {word(i)}xv {word(i)}zz", f"l{i:04}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    filters = langid.learn(docs)
    assert len(filters.names) == 1100
    whole = langid.Filters(langid._by_language(_grams(docs)), dict.fromkeys(filters.names, 1))
    assert (whole.cells == filters.cells).all() and (whole.chance == filters.chance).all()
    got = langid.identify(docs, filters).toPandas()
    assert (got.lang_pred == got.lang).all()


def _grams(docs):
    return docs.mapInArrow(langid._count, "lang string, gram bigint, n bigint").select("lang", "gram")


def test_ngrams_stay_in_their_text_and_fold_letters():
    data = "Été la".encode() + b"VILLE" + b"9"
    a, text = langid.ngrams(np.frombuffer(data, np.uint8), np.array([0, 8, 13, 14]))
    b, _ = langid.ngrams(np.frombuffer("été LA".encode() + b"ville" + b"7", np.uint8), np.array([0, 8, 13, 14]))
    assert a.tolist() == b.tolist() and set(text.tolist()) == {0, 1}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [("the cat and the dog", "en")] * 3 + [("le chat et le chien", "fr"), (None, "xx"), ("", "yy"), ("a", None)]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    result = langid.identify(docs, filters)
    assert result.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    got = result.toPandas()
    assert len(got) == 17 and got.lang_score.between(0, 1).all()
    assert set(got[got.doc_id.isin([0, 1, 2, 3, 13])].lang_pred) == {"und"}
    assert got[got.doc_id == 11].lang_pred.tolist() == ["en"]  # nothing known: the most usual language
    assert langid.identify(docs.filter(F.lit(False)), filters).count() == 0
    nothing = langid.learn(docs.select("text", "lang").filter("lang IS NULL"))
    assert set(langid.identify(docs, nothing).toPandas().lang_pred) == {"und"}


def test_rows_of_a_task_are_added_up_in_bounded_steps(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"text": [f"word{i} again" for i in range(300)] * 2, "lang": ["a", "b"] * 300}
    )

    def total():
        parts = [b.to_pandas() for b in langid._count(iter([batch, batch]))]
        return len(parts), pd.concat(parts).groupby(["lang", "gram"]).n.sum()

    once, whole = total()
    monkeypatch.setattr(langid, "GATHERED", 10)
    often, parts = total()
    assert once == 1 and often > 1 and whole.equals(parts)
