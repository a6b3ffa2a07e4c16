"""Hashed character n-grams of many words at once, and a worker's cache of what a model makes of a word."""

from __future__ import annotations

import numpy as np


def ngram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of every word, each word standing between two marks."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    grams, owners = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = word[: len(h)] == word[n - 1 :]
        grams.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(word[: len(h)][inside])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)


def plain(word: str) -> str:
    """A word without anything but letters and digits."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


class WordCache(dict):
    """Word -> row of a table of model values; both start afresh when they hold ``size`` words."""

    def __init__(self, values_of, width: int, size: int = 200_000):
        super().__init__()
        self.values_of, self.size = values_of, size
        self.table = np.zeros((1024, width))

    def rows(self, texts: list[list[str]]) -> None:
        """Makes rows for all words of some texts."""
        new = list(set().union(*texts) - self.keys())
        if len(self) + len(new) > self.size and len(self):
            self.clear()
            new = list(set().union(*texts))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            at = len(self)
            if at + len(part) > len(self.table):
                grown = np.zeros((2 * (at + len(part)), self.table.shape[1]))
                grown[:at] = self.table[:at]
                self.table = grown
            self.table[at : at + len(part)] = self.values_of(part)
            self.update(zip(part, range(at, at + len(part)), strict=True))
