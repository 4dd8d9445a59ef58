"""Character n-grams of words, hashed, and a bounded cache of what each distinct word contributes to a text."""

from __future__ import annotations

import numpy as np

from ecorisk.llm.common import mix, odd_multipliers, slices, worker_cache

#: Words remembered per Python worker; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 200_000


def ngram_features(words: list[str], orders: range, buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of each character n-gram of each word between boundary marks; `whole` adds the word itself.

    Sorted by word. Words must not be empty.
    """
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2  # a word may hold any character, U+0000 too
    word = np.repeat(np.arange(len(words)), lengths)
    rows, cols = [], []
    scrambled = mix(codes + np.uint64(1))
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k, x in enumerate(odd_multipliers(n, 7 + n)):
            h += scrambled[k : k + m] * x
        inside = word[:m] == word[n - 1 :]
        rows.append(word[:m][inside])
        cols.append((mix(h[inside]) % np.uint64(buckets)).astype(np.int64))
    if whole:
        first, far = np.cumsum(lengths) - lengths, np.uint64(0x9E3779B97F4A7C15)
        place = (np.arange(len(codes)) - first[word]).astype(np.uint64)
        h = np.add.reduceat(mix(scrambled ^ (place * far)), first) + mix(mix(np.ones(1, np.uint64)) ^ (lengths.astype(np.uint64) * far))
        rows.append(np.arange(len(words)))
        cols.append((mix(h) % np.uint64(buckets)).astype(np.int64))
    row, col = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


class WordTable(dict):
    """word -> row of `values`, filled as words are met; `score(words)` gives the rows of new words."""

    def __init__(self, score, width: int):
        super().__init__()
        self.score, self.width = score, width
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.values = np.zeros((1024, self.width))

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        """values[i] of each word, in order."""
        if len(self) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            if len(self) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((2 * len(self) - len(self.values), self.width))])
            self.values[len(self) - len(self.fresh) : len(self)] = self.score(self.fresh)
            self.fresh = []
        return self.values[at]

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum over each whole text's words, number of words)."""
        out, counts = np.zeros((len(texts), self.width)), np.zeros(len(texts), np.int64)
        for a, b in slices([len(t) for t in texts]):
            split = [t.lower().split() for t in texts[a:b]]
            n = np.array([len(w) for w in split])
            counts[a:b] = n
            if n.sum():
                rows, full = self.rows([w for ws in split for w in ws]), n > 0
                out[a:b][full] = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(n[full])[:-1]]))
        return out, counts


def word_table(key: str, score, width: int) -> WordTable:
    """This worker's table for the model `key`."""
    return worker_cache(("words", key), lambda: WordTable(score, width))
