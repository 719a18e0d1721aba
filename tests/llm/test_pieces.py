"""Ids and texts against the library, on documents and on made-up texts."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.plain import ODD_TEXTS, TABLES, documents, odd_documents

from ticketmill.llm import pieces
from ticketmill.llm.memory import Memory
from ticketmill.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def both_ways(model, texts):
    words = pieces.cut(model)
    ids, at = Memory(lambda fresh: pieces.encode_words(model, fresh)).encode([words(t) for t in texts])
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], pieces.decode_ids(model, ids, at)


@pytest.mark.parametrize(
    "alphabet", ["abcdeinrst  \n\t,.;'ÉéßñΩ中字😀▁\u0301\x00<unk></s>0A", "ehtrnaios ", "aaab", " ▁\na"]
)
def test_random_texts(model, library, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(2000)]
    ids, decoded = both_ways(model, texts)
    assert ids == library.encode(texts) and decoded == library.decode(ids)


def test_long_words(model, library):
    texts = ["banana" * 500, "e" * 3000, "abababab" * 700, "中" * 2000, " " * 999, "x" + "\n" * 50]
    ids, decoded = both_ways(model, texts)
    assert ids == library.encode(texts) and decoded == library.decode(ids)


@pytest.mark.parametrize("unit, times", [("th", 500_000), ("the", 300_000), ("ing", 300_000), (None, 1_000_000)])
def test_words_of_a_megabyte_take_seconds(model, library, unit, times):
    rng = random.Random(times)
    text = unit * times if unit else "".join(rng.choice("ethainors") for _ in range(times))
    begun = time.monotonic()
    ids, decoded = both_ways(model, [text, "short", text[:70_001]])
    assert time.monotonic() - begun < 15  # about one second each; the square of the length would be hours
    texts = [text, "short", text[:70_001]]
    assert ids == library.encode(texts) and decoded == texts


@pytest.mark.parametrize("alphabet", ["eth", "ehtrnaios", "aaab", "▁ta", "inog"])
def test_words_finished_by_the_queue(model, library, alphabet, monkeypatch):
    monkeypatch.setattr(pieces, "ROUNDS", 2)
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(500)]
    assert both_ways(model, texts)[0] == library.encode(texts)


def test_the_memory_keeps_no_long_words(model, library):
    rng = random.Random(4)
    memory, words = Memory(lambda fresh: pieces.encode_words(model, fresh)), pieces.cut(model)
    for _ in range(30):
        texts = [
            " ".join("".join(rng.choice("etaoin") for _ in range(rng.choice((3, 5, 64, 5000)))) for _ in range(9))
            for _ in range(20)
        ]
        ids, at = memory.encode([words(t) for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library.encode(texts)
    assert max(map(len, memory.index)) <= 64 and sorted(memory.index.values()) == list(range(len(memory.index)))
    assert memory.used <= sum(map(len, memory.index))


def test_any_ids_decode_like_the_library(model, library):
    rng = random.Random(6)
    rows = [
        [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(12))]
        for _ in range(2000)
    ]
    flat = np.array([i for r in rows for i in r], np.int32)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert pieces.decode_ids(model, flat, at) == [library.decode(r) for r in rows]


def test_all_documents(spark, library):
    docs = documents()
    got = QUERIES["op10_sentencepiece_rounds"](spark, TABLES).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, ids in zip(docs.doc_id, library.encode(docs.text.tolist())):
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, library):
    encoded = pieces.encode(odd_documents(spark), PATH)
    rows = pieces.decode(encoded, PATH).toPandas()
    once = pieces.encode(odd_documents(spark), PATH, decoded=True).toPandas()
    assert len(rows) == 17 and sorted(rows.text) == sorted(once.text)
    for r in rows.dropna(subset="doc_id").itertuples():
        text = ODD_TEXTS[int(r.doc_id)] or ""
        assert list(r.ids) == library.encode(text) and r.text == library.decode(library.encode(text))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(empty, PATH), PATH).count() == 0


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as schema

    other = schema.ModelProto()
    with open(PATH, "rb") as f:
        other.ParseFromString(f.read())
    other.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(other.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "other.model"))
