"""A quality classifier made of rules: paths of trees over text statistics, weighted by a lasso.

Shallow trees are boosted on a bounded sample of labelled documents. Every path from a root becomes
a conjunctive rule, a lasso logistic regression keeps the rules that help, and what is left is
compiled into one Spark column expression. Statistics are computed once per document over its whole
text; labels are used in training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_GAP, Words, distinct_per_text, lowest_hashes, prepare, staged, text_chunks

#: Labelled documents that a model is fitted on at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_LEAF = 40, 3, 32, 20
SHRINKAGE = 0.3
PENALTIES = [0.01, 0.003, 0.001, 0.0003]

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "exclamations", "bars", "symbols",
    "punctuation", "beyond_ascii", "distinct", "repeated", "lines",
]

_CLASSES = np.full(256, 8)
_CLASSES[0x21:0x7F] = 7
for _k, _members in enumerate(
    [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b"!", b"|", b"#$%&*+<=>@\\^_`{}~[]/", b"\n"]
):
    _CLASSES[list(_members)] = _k
_CLASSES[0x80:] = 9


def statistics(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a text without words has zeros."""
    texts = len(offsets) - 1
    text = np.repeat(np.arange(texts), np.diff(offsets))
    seen = np.bincount(text * 10 + _CLASSES[data], minlength=10 * texts).reshape(texts, 10).astype(float)
    filled = np.bincount(text, ~IS_GAP[data], texts)
    hashes, at = words(data, offsets)
    n = np.diff(at).astype(float)
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][n > 0]] = 0
    repeated = np.bincount(np.repeat(np.arange(texts), np.diff(at)), same, texts)
    distinct = np.diff(distinct_per_text(hashes, at)[1])
    small, large, digits, exclaimed, bars, symbols, lines, marks, _, beyond = seen.T
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(filled, 1)
    return np.column_stack(
        [
            np.log2(1 + np.diff(offsets)), np.log2(1 + n), filled * per_word,
            large / np.maximum(small + large, 1), digits * per_byte, exclaimed * per_word,
            bars * per_word, symbols * per_word, marks * per_word, beyond * per_byte,
            distinct * per_word, repeated * per_word, lines * per_word,
        ]
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``stat_<name>`` for every statistic; older ones are replaced."""
    prepare(docs.sparkSession)
    names = [f"stat_{s}" for s in STATISTICS]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for rows, data, offsets in text_chunks(batches, text):
            found = statistics(data, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *[pa.array(np.ascontiguousarray(c)) for c in found.T]],
                [*rows.schema.names, *names],
            )

    schema = [f"`{c}` {t}" for c, t in docs.dtypes] + [f"{n} double" for n in names]
    return docs.mapInArrow(run, ", ".join(schema))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # value > cut, else value <= cut
    cut: float


@dataclass
class RuleModel:
    """log-odds = base + the weights of all rules that hold."""

    base: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """The chance of label 1 as an expression over ``stat_`` columns."""

        def holds(c: Condition) -> Column:
            value = F.col(f"stat_{c.statistic}")
            return value > c.cut if c.above else value <= c.cut

        total = F.lit(float(self.base))
        for conditions, weight in self.rules:
            together = holds(conditions[0])
            for c in conditions[1:]:
                together = together & holds(c)
            total = total + F.when(together, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(binned, cuts, residual, curvature, rows, depth, path, rules) -> np.ndarray:
    """Fit a tree to the residuals; adds every path to ``rules`` and gives the tree's values."""
    value = np.zeros(len(residual))
    value[rows] = residual[rows].sum() / (curvature[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return value
    best = (1e-9, None, None)
    whole, bent = residual[rows].sum(), curvature[rows].sum() + 1.0
    for s in range(binned.shape[1]):
        size = len(cuts[s]) + 1
        b = binned[rows, s]
        g = np.cumsum(np.bincount(b, residual[rows], size))[:-1]
        h = np.cumsum(np.bincount(b, curvature[rows], size))[:-1] + 1.0
        n = np.cumsum(np.bincount(b, minlength=size))[:-1]
        gain = g**2 / h + (whole - g) ** 2 / np.maximum(bent + 1.0 - h, 1e-9) - whole**2 / bent
        gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), s, int(gain.argmax()))
    if best[1] is None:
        return value
    _, s, k = best
    above = binned[rows, s] > k
    for side, part in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, Condition(STATISTICS[s], side, float(cuts[s][k])))
        rules.append(longer)
        value[part] = _grow(binned, cuts, residual, curvature, part, depth - 1, longer, rules)[part]
    return value


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, base: float, w: np.ndarray, steps: int = 300):
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    rate = 4 * len(x) / max((x**2).sum(axis=1).max() * len(x) / 2, 1.0)
    ahead, far, momentum = w, base, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ ahead + far))) - y
        moved = ahead - rate * (x.T @ error) / len(x)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_base = far - rate * error.mean()
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / faster * (new - w)
        far = new_base + (momentum - 1) / faster * (new_base - base)
        w, base, momentum = new, new_base, faster
    return base, w


def _loss(x, y, base, w) -> float:
    z = x @ w + base
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Rules and weights from a matrix of statistics and 0/1 labels.

    Without rows every score is 0.5; with a single label it is close to that label.
    """
    if not len(y):
        return RuleModel()
    y = y.astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return RuleModel(base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    paths: list[tuple[Condition, ...]] = []
    f = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        rules: list[tuple[Condition, ...]] = []
        tree = _grow(binned, cuts, y - p, p * (1 - p), rows, DEPTH, (), rules)
        paths += rules
        out = np.setdiff1d(np.arange(len(y)), rows)
        f[rows] += SHRINKAGE * tree[rows]
        for leaf in _leaves(rules):
            inside = out[_holds(leaf, x[out])]
            members = rows[_holds(leaf, x[rows])]
            if len(members):
                f[inside] += SHRINKAGE * tree[members[0]]
    paths = list(dict.fromkeys(paths))
    if not paths:
        return RuleModel(base)
    flags = np.column_stack([_holds(r, x) for r in paths]).astype(float)
    # Rules that hold for the same documents count once.
    _, first = np.unique(flags, axis=1, return_index=True)
    first = np.sort(first)
    paths, flags = [paths[i] for i in first], flags[:, first]
    test = rng.random(len(y)) < 0.25
    start, best = (base, np.zeros(len(paths))), (np.inf, PENALTIES[-1])
    for penalty in PENALTIES:
        start = _lasso(flags[~test], y[~test], penalty, *start)
        if test.any():
            best = min(best, (_loss(flags[test], y[test], *start), penalty))
    base, weights = _lasso(flags, y, best[1], *start)
    return RuleModel(float(base), [(r, float(w)) for r, w in zip(paths, weights) if abs(w) > 1e-6])


def _leaves(rules):
    prefixes = {r[:-1] for r in rules}
    return [r for r in rules if r not in prefixes]


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        value = x[:, STATISTICS.index(c.statistic)]
        out &= value > c.cut if c.above else value <= c.cut
    return out


def train(described: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> RuleModel:
    """A model from ``described`` (doc_id and statistics) and ``labels`` (doc_id, quality).

    Labels other than 0 and 1 are left out. At most ``sample`` labelled rows are used, those with the
    lowest hashes; partitions and the order of rows have no say in the choice.
    """
    known = described.join(
        labels.select("doc_id", "quality").filter("quality IN (0, 1)"), "doc_id"
    ).select("doc_id", "quality", *[f"stat_{s}" for s in STATISTICS])
    rows = lowest_hashes(staged(known, "labelled"), sample).drop("doc_id").collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, 1 + len(STATISTICS))
    data = data[np.lexsort(data.T[::-1])]  # the fit does not depend on the order of the rows
    return fit(data[:, 1:], data[:, 0])
