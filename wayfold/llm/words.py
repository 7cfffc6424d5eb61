"""Scores that add up over words: frequencies of a text's words, joined to a bounded table of what each word gives."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

#: Words whose rows a worker holds between batches.
CACHE = 200_000


class WordTable:
    """Rows of numbers by word, worked out when first met and held up to ``CACHE`` words."""

    def __init__(self, rows: Callable[[list[bytes]], np.ndarray]):
        self.rows = rows
        self.at: dict[bytes, int] = {}
        self.held: np.ndarray | None = None

    def sums(self, texts: list[list[bytes]], presence: bool = False) -> np.ndarray:
        """For each list of words the sum of their rows, times frequency unless ``presence``."""
        if len(self.at) > CACHE:
            self.at, self.held = {}, None
        counts = [Counter(words) for words in texts]
        new = list({w for c in counts for w in c if w not in self.at})
        if new or self.held is None:
            made = self.rows(new)
            used = len(self.at)
            self.at.update(zip(new, range(used, used + len(new)), strict=True))
            if self.held is None or used + len(made) > len(self.held):
                grown = np.zeros((max(1024, 2 * (used + len(made))), made.shape[1]), made.dtype)
                if self.held is not None:
                    grown[:used] = self.held[:used]
                self.held = grown
            self.held[used : used + len(made)] = made
        out = np.zeros((len(texts), self.held.shape[1]))
        for i, c in enumerate(counts):
            if c:
                rows = self.held[np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))]
                out[i] = rows.sum(0) if presence else np.fromiter(c.values(), np.float64, len(c)) @ rows
        return out
