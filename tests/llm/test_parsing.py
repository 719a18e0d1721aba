"""Locally consistent parsing against a plain version, and fingerprints of neighbouring documents."""

import hashlib
import random
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
from llm.plain import TABLES, documents, odd_documents

from ticketmill.llm import parsing, queries
from ticketmill.llm.common import U64, mix

WORD = (1 << 64) - 1


def mixed(x):
    return int(mix(np.array([x & WORD], U64))[0])


def tossed(symbols, bits):
    out = []
    for i, x in enumerate(symbols):
        differ = (symbols[i - 1] if i else ~x & ((1 << bits) - 1)) ^ x
        at = (differ & -differ).bit_length() - 1
        out.append(2 * at + (x >> at & 1))
    return out


def cut(symbols, bits):
    labels = tossed(symbols, bits)
    for _ in range(4 if bits == 64 else 3):
        labels = tossed(labels, 8)
    begins = [0] + [
        i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]
    ]
    return list(zip(begins, [*begins[1:], len(symbols)]))


def bytes_name(part):
    weights, lengths = parsing.WEIGHTS.tolist(), parsing.LENGTHS.tolist()
    if len(part) > 16:
        return mixed(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little"))
    total = int.from_bytes(part[:8], "little") * weights[0] + lengths[len(part)]
    return mixed(total + int.from_bytes(part[8:], "little") * weights[1])


def plain_levels(data):
    """Names of the phrases of every level, and the name of the whole."""
    runs = [bytes(g) for _, g in groupby(data)]
    names = [bytes_name(b"".join(runs[a:b])) for a, b in cut([r[0] for r in runs], 8)]
    levels = [names]
    while True:
        symbols = []
        for name, copies in groupby(names):
            n = len(list(copies))
            symbols.append(name if n == 1 else mixed(name + n))
        if len(symbols) == 1:
            return levels, symbols[0]
        weights, lengths = parsing.WEIGHTS.tolist(), parsing.LENGTHS.tolist()
        names = [
            mixed(sum(x * weights[i] for i, x in enumerate(symbols[a:b])) + lengths[b - a])
            for a, b in cut(symbols, 64)
        ]
        levels.append(names)


def run_of(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def test_phrases_equal_a_plain_parse():
    rng = random.Random(4)
    texts = ["", "a", "ab", "aaaa", "ab" * 40, "x" * 200 + "y", "", "née ß 日本" * 9, "abcabcabc" * 5]
    texts += ["".join(rng.choice("abc de") for _ in range(rng.randrange(200))) for _ in range(120)]
    texts += ["q" * rng.randrange(1, 40) + "z" * rng.randrange(40) + "!" for _ in range(20)]
    levels, roots = parsing.parse(*run_of(texts))
    for i, text in enumerate(texts):
        own = [names[of == i].tolist() for of, names in levels if (of == i).any()]
        if not text:
            assert own == [] and roots[i] == 0
            continue
        expected, root = plain_levels(text.encode())
        assert own == expected and int(roots[i]) == root


def test_a_passage_is_cut_alike_wherever_it_stands():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(500))
    texts = [passage]
    for _ in range(20):
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(2))
        texts.append(before + passage + after)
    levels, _ = parsing.parse(*run_of(texts))
    for number, least in ((1, 0.99), (2, 0.97), (3, 0.95), (4, 0.85)):
        of, names = levels[number - 1]
        own = set(names[of == 0].tolist())
        for i in range(1, len(texts)):
            assert len(own & set(names[of == i].tolist())) >= least * len(own) - 3


def test_likeness_is_the_share_of_names_in_common():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "

    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    errors = []
    for size in (40, 300, 3000, 30_000) * 6:
        a, b = text(size), text(size)
        other = a[: size // 2] + b[: size // 2]
        sketch = parsing.sketches(*run_of([a, other, b, a]))
        row = lambda i: tuple(x[i : i + 1] for x in sketch)  # noqa: E731, B023
        assert parsing.likeness(row(0), row(3))[0] == 1.0
        assert parsing.likeness(row(0), row(2))[0] < 0.1
        errors.append(parsing.likeness(row(0), row(1))[0] - 0.5)
        again = parsing.read(parsing.written(*row(1)))
        assert all((x == y).all() for x, y in zip(again, row(1)))
    assert abs(np.mean(errors)) < 0.06 and np.abs(errors).max() < 0.25


def plain_rows(rows):
    """(doc_id, text) pairs in the order of the operator -> expected texts."""
    rows = [(i, t or "") for i, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        out.setdefault(i, []).append((t, t[: n - n // 2] + after[: n // 2], after))
    return out


def held(found, expected):
    def one(text):
        return parsing.sketches(*run_of([text]))

    for r in found:
        text, edited, after = expected[r.doc_id][0]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == parsing.written(*one(text))[0]
        assert r.edited_fingerprint == parsing.written(*one(edited))[0]
        assert r.near_edited == pytest.approx(parsing.likeness(one(text), one(edited))[0])
        assert r.near_next == pytest.approx(parsing.likeness(one(text), one(after))[0])


def test_query_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PART_BYTES", 200_000)
    found = queries.QUERIES["op11_parsing_fingerprints"](spark, TABLES).collect()
    docs = documents().sort_values("doc_id", ascending=False)
    assert len(found) == len(docs)
    held(found, plain_rows(zip(docs.doc_id.tolist(), docs.text.tolist())))
    near = pd.DataFrame(found, columns=["doc_id", "n", "e", "f", "g", "near_edited", "near_next"])
    assert near.near_edited.mean() > 0.4 and near.near_next.mean() < 0.02


@pytest.mark.parametrize("part", [40, 1 << 23])
def test_odd_rows(spark, monkeypatch, part):
    monkeypatch.setattr(parsing, "PART_BYTES", part)
    docs = odd_documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    found = parsing.fingerprints(docs).collect()
    assert len(found) == len(rows)
    held(found, plain_rows(rows))
    everything = parsing.fingerprints(odd_documents(spark)).collect()
    assert len(everything) == odd_documents(spark).count()
    assert [r.n_chars for r in everything if r.doc_id is None] == [30]


def test_repeated_ids_copies_one_row_and_none(spark):
    schema = "doc_id long, text string"
    rows = [(7, "same text of some length")] * 40 + [(7, "another"), (3, "the last one"), (None, None)] * 2
    found = parsing.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows)
    assert len({r.fingerprint for r in found}) == 4
    assert sum(r.near_next == 1.0 for r in found if r.n_chars == 24) >= 39
    one = parsing.fingerprints(spark.createDataFrame([(1, "abcd")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert parsing.fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("some text", "some text"), (None, ""), ("ab", None)], "a string, b string")
    marked = df.select(parsing.fingerprint(df.a).alias("x"), parsing.fingerprint(df.b).alias("y"))
    assert [r[0] for r in marked.select(parsing.alike(marked.x, marked.y)).collect()] == [1.0, 1.0, 0.0]
