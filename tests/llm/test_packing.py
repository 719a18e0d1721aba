"""Packing: ids against the library, plans against the optimum, places of all pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
from llm.plain import ODD_TEXTS, documents, odd_documents
from tokenizers import Tokenizer

from ticketmill.llm import packing
from ticketmill.llm.memory import Memory

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abIst'  \n\t,.!éÉßñ中Σς😀́\x1c\x0b\u200b ​123İDŽǆ<|>_-re"


def library(texts):
    found = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found]


def test_words_apart_give_the_ids_of_the_whole_text():
    rng = random.Random(2)
    texts = ["it's !'s a!'s 12'll '' 's", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΑΣ, İ", "ab\u0301! x"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(4000)]
    ids, at = Memory(packing.word_encoder(PATH)).encode(
        [packing.cut(t.encode().lower().decode()) for t in texts]
    )
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(texts)


def test_added_tokens_are_told_by_case(spark):
    rng = random.Random(5)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> Hello", "A<|StartOfText|>B", "It's <|endoftext|>IT'S <|x|> Ab"]
    for _ in range(1000):
        parts = rng.choices(["<|endoftext|>", "<|startoftext|>", "<|", "|>", *ALPHABET, "Q", "'S"], k=12)
        texts.append("".join(p.swapcase() if rng.random() < 0.3 else p for p in parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.tokenize(df, PATH).toPandas().set_index("doc_id").ids
    found = [np.frombuffer(rows[i], "<u4").tolist() for i in range(len(texts))]
    assert found == [[*ids, 0] for ids in library(texts)]


def test_a_full_memory_changes_nothing(monkeypatch):
    import ticketmill.llm.memory as module

    monkeypatch.setattr(module, "REMEMBERED", 5)
    memory = Memory(packing.word_encoder(PATH))
    for texts in (["a b c d e f g h", "a x"], ["i j k a", ""], ["a b zz", "zz q"]):
        ids, at = memory.encode([t.split() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(texts)


def sequences(plan: packing.Plan, capacity: int) -> list[list[int]]:
    out = [[] for _ in range(plan.sequences)]
    for length, _, count, first, each, offset in plan.entries:
        for k in range(count * each):
            out[first + k // each].append((offset + k % each * length, length))
    for s in out:
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()]
        assert sum(n for _, n in s) <= capacity
    return [[n for _, n in s] for s in out]


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), len(items)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(items):
            best = len(loads)
            return
        for j in {load: j for j, load in enumerate(loads) if load + items[i] <= capacity}.values():
            loads[j] += items[i]
            place(i + 1, loads)
            loads[j] -= items[i]
        place(i + 1, [*loads, items[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randrange(10))]
        counts = {n: items.count(n) for n in items}
        plan = packing.Plan(counts)
        packing.reduce_dominated(plan, capacity)
        left = [n for n, c in plan.counts.items() for _ in range(c)]
        assert plan.sequences + fewest(left, capacity) == fewest(items, capacity)
        whole = packing.make_plan(counts, capacity)
        assert sorted(n for s in sequences(whole, capacity) for n in s) == sorted(items)


def test_reduction_goes_on_after_a_length_without_a_dominating_set():
    plan = packing.Plan({60: 1, 55: 1, 45: 1, 5: 4})
    packing.reduce_dominated(plan, 100)
    assert plan.counts == {60: 1, 5: 4} and sequences(plan, 100) == [[55, 45]]


def test_large_instances_are_close_to_the_bound():
    rng = random.Random(4)
    counts = {n: rng.randrange(3_000_000) for n in range(1, 2049)}
    plan = packing.make_plan(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert bound <= plan.sequences <= 1.02 * bound and len(plan.entries) < 100_000


def check(texts, rows):
    """Every piece has its place; sequences are gapless and hold what the library says."""
    ids = {i: [*x, 0] for i, x in zip(texts, library([t or "" for t in texts.values()]))}
    for r in rows.itertuples():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert rows.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    assert (rows[rows.groupby("doc_id").piece.transform("max") != rows.piece].length == 2048).all()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1


def run(docs):
    from pyspark.sql import functions as F

    pieces = packing.tokenize(docs, PATH).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"]).toPandas()


def test_all_documents(spark):
    docs = documents()
    check(dict(zip(docs.doc_id, docs.text)), run(spark.createDataFrame(docs)))


def test_odd_rows(spark):
    rows = run(odd_documents(spark))
    kept = rows[rows.doc_id.isin([i for i in range(len(ODD_TEXTS)) if i not in (4, 5)])]
    texts = {i: t for i, t in enumerate(ODD_TEXTS) if i not in (4, 5)}
    assert kept.groupby("doc_id").length.sum().to_dict() == {
        i: len(x) + 1 for i, x in zip(texts, library([t or "" for t in texts.values()]))
    }
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert len(run(spark.createDataFrame([], "doc_id long, text string"))) == 0
