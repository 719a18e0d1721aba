"""Plain versions of the operators for small inputs, and odd rows that every operator must take."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd

TABLES = "/root/testdata/sf0.01"

#: Texts that are null, empty, blank, without letters, very short, very long, repeated.
ODD_TEXTS = [
    None, "", "   \n\t", "!!! 123", "a", "one two three four", "one two three four", "é",
    "word " * 40_000, "x" * 300_000, "\x00 zero", "日本語のテキスト", "<|endoftext|> </s> ▁ <unk>", "😀" * 50,
]


def odd_documents(spark):
    """Documents with odd texts, a null id, a repeated row and columns that clash."""
    rows = [(i, t, None, None, None, "x", 0.5, 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here at all, really none", "en", "s", 1, "y", 0.1, 0), rows[5], rows[4]]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "lang_pred string, score double, shard int",
    )


def documents(tables: str = TABLES) -> pd.DataFrame:
    return pd.read_parquet(f"{tables}/documents.parquet")


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(nodes, edges) -> dict:
    """The smallest member that can be reached from every node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_components(texts: dict[int, str | None], percent: int = 75) -> dict[int, int]:
    """Smallest id reachable over pairs whose shingle sets have the similarity."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    edges = [(ids[0], other) for ids in by_set.values() for other in ids[1:]]
    heads = [(ids[0], s) for s, ids in by_set.items()]
    posting = defaultdict(list)
    for k, (_, s) in enumerate(heads):
        for shingle in s:
            posting[shingle].append(k)
    for k, (i, s) in enumerate(heads):
        for m, shared in Counter(m for x in s for m in posting[x] if m < k).items():
            if 100 * shared >= percent * (len(s) + len(heads[m][1]) - shared):
                edges.append((i, heads[m][0]))
    return components(sets, edges)


def auc(scores, labels) -> float:
    ranks, labels = pd.Series(scores).rank().to_numpy(), pd.Series(labels).to_numpy()
    ones, zeros = int((labels == 1).sum()), int((labels == 0).sum())
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
