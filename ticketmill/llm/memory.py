"""Token ids of words met before, so that a worker encodes a frequent word once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words a Python worker remembers; once full, it keeps what it has and encodes others as they come.
REMEMBERED = 300_000
#: Characters of the longest word remembered, so what a worker keeps is bounded in bytes as well.
LONGEST = 64


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values[np.repeat(starts, lengths) + ramp(lengths)]


class Index(dict):
    """Words numbered in the order they are first asked for; ``fresh`` has those not yet encoded."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Memory:
    """The ids of words seen before, as slices of one growing array."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_words = encode_words  # words -> (ids, offsets)
        self.index = Index()
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _room(self, name: str, used: int, more: int) -> None:
        old = getattr(self, name)
        if used + more > len(old):
            new = np.zeros(max(2 * len(old), used + more), old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)

    def _learn(self) -> list[str]:
        """Encode the words that were new; gives them back."""
        words, self.index.fresh = self.index.fresh, []
        ids, offsets = self.encode_words(words)
        n = len(self.index) - len(words)
        for name in ("starts", "lengths"):
            self._room(name, n, len(words))
        self._room("ids", self.used, len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(words)] = self.used + offsets[:-1]
        self.lengths[n : n + len(words)] = np.diff(offsets)
        return words

    def _forget(self, fresh: list[str]) -> None:
        """Keep the new words while there is room, but no long ones."""
        known = len(self.index) - len(fresh)
        if len(self.index) > REMEMBERED:
            for word in fresh:
                del self.index[word]
            return
        if max(map(len, fresh)) > LONGEST:
            # The others move up, so that numbers and ids stay without gaps.
            kept = [i for i, word in enumerate(fresh) if len(word) <= LONGEST]
            for word in fresh:
                if len(word) > LONGEST:
                    del self.index[word]
            self.index.update((fresh[i], known + k) for k, i in enumerate(kept))
            at = known + np.array(kept, np.int64)
            starts, lengths = self.starts[at], self.lengths[at]
            ids = gather(self.ids, starts, lengths)
            now = slice(known, known + len(kept))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[now], self.lengths[now] = self.used + np.cumsum(lengths) - lengths, lengths
            self.used += len(ids)
        else:
            last = len(self.index) - 1
            self.used = int(self.starts[last] + self.lengths[last])
        if len(self.ids) > 2 * self.used + (1 << 20):
            self.ids = self.ids[: self.used + (1 << 16)].copy()

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given as their words."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        asked = map(self.index.__getitem__, chain.from_iterable(texts))
        at = np.fromiter(asked, np.int64, int(counts.sum()))
        fresh = self._learn() if self.index.fresh else []
        lengths = self.lengths[at]
        ids = gather(self.ids, self.starts[at], lengths)
        if fresh:
            self._forget(fresh)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.concatenate([[0], np.cumsum(counts)])]
