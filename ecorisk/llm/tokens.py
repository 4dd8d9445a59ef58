"""Token ids of whole texts, by the tokenizers library, with each distinct piece of text encoded once per worker.

Both vocabularies split a text before they merge, so a text's ids are those of its pieces in order wherever the cut is
one that the splitting rule makes anyway. Texts in which that isn't certain are encoded whole. Null counts as empty.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from ecorisk.llm.common import slices, worker_cache

#: Pieces, and characters of them, remembered per worker; beyond either the memory is emptied and filled anew.
CACHE_PIECES, CACHE_CHARS = 600_000, 16 << 20
#: Pieces of these characters alone (no white space, nothing that normalisation changes in length) are encoded many at a
#: time, as one text, and told apart by the bytes that each id stands for; all others are encoded one by one.
PLAIN = {"space": re.compile(r"[\n ][!-~¡-¬®-ÿ]+"), "words": re.compile(r"[!-~¡-¬®-ÿ]+")}
JOINED = 256


class Encoder(dict):
    """piece -> its number; numbers index the pieces' ids.

    Rule 'space' (byte-level, a space goes with the word after it): each single space or line feed opens a piece, written
    without that space; a text's first piece is marked by a leading null character. Rule 'words' (white space is
    dropped): pieces are what stands between spaces and line feeds.
    """

    def __init__(self, path: str, rule: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer, self.rule = Tokenizer.from_file(path), rule
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1 + len(self.tokenizer.get_added_tokens_decoder()), np.int64)
        for token, i in vocabulary.items():  # one character stands for one byte
            self.id_bytes[i] = len(token.removesuffix("</w>") if rule == "words" else token)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.used, self.chars = np.zeros(1 << 16, np.uint32), 0, 0
        self.first, self.count, self.sure = [np.zeros(1 << 14, t) for t in (np.int64, np.int32, bool)]

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.fresh.append(piece)
        return at

    def pieces(self, text: str) -> list[str]:
        if self.rule == "words":
            return text.replace("\n", " ").split(" ")
        return ("\0" + text.replace("\n", " \n")).split(" ")

    def _written(self, piece: str) -> str:
        """The stretch of text that a piece stands for."""
        if self.rule == "words" or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def _certain(self, text: str) -> bool:
        """Whether the rule cuts before and after this stretch: it has no white space but the one that opens it."""
        return self.rule == "words" or len(text.strip()) > 0 and not any(map(str.isspace, text[1:])) and (text[0] in " \n" or not text[0].isspace())

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keeps the ids of the pieces with these numbers, one after another in `ids`."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.used += len(ids)

    def _learn(self) -> None:
        at, texts = len(self) - len(self.fresh), [self._written(x) for x in self.fresh]
        self.chars += sum(map(len, self.fresh))
        if len(self) > len(self.first):
            self.first, self.count, self.sure = [np.concatenate([x, np.zeros(2 * len(self) - len(x), x.dtype)]) for x in (self.first, self.count, self.sure)]
        plain, gap = PLAIN[self.rule].fullmatch, " " if self.rule == "words" else ""
        known = np.array([plain(x) is not None and "<|" not in x for x in texts], bool)
        own = [x for x, k in zip(texts, known, strict=True) if k]
        ids = self._each([gap.join(own[k : k + JOINED]) for k in range(0, len(own), JOINED)])
        reached = np.cumsum(self.id_bytes[np.concatenate(ids)]) if ids else np.empty(0, np.int64)
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in own), np.int64, len(own)))
        cuts = np.searchsorted(reached, ends) + 1
        if own and (cuts[-1] != len(reached) or (reached[cuts - 1] != ends).any()):  # not told apart: one by one
            known[:], own = False, []
        if own:
            self._add(at + np.flatnonzero(known), np.concatenate(ids), np.diff(cuts, prepend=0))
            self.sure[at + np.flatnonzero(known)] = True
        rest = np.flatnonzero(~known)
        if len(rest):
            ids = self._each([texts[i] for i in rest])
            self._add(at + rest, np.concatenate(ids), np.array([len(x) for x in ids]))
            self.sure[at + rest] = [self._certain(texts[i]) for i in rest]
        self.fresh = []

    def encode(self, texts: list[str], end: int):
        """The ids of each text with `end` after them, in order."""
        for a, b in slices([len(t) for t in texts]):
            if len(self) > CACHE_PIECES or self.chars > CACHE_CHARS:
                self.forget()
            split = [self.pieces(t) if t else [] for t in texts[a:b]]
            sizes = np.array([len(x) for x in split], np.int64)
            at = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            if self.fresh:
                self._learn()
            n = self.count[at]
            place = np.cumsum(n, dtype=np.int64) - n
            ids = self.flat[np.repeat(self.first[at] - place, n) + np.arange(int(n.sum()))]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            starts = np.concatenate([place, [len(ids)]])[edges]
            unsure = np.concatenate([[0], np.cumsum(~self.sure[at])])[edges]
            for i in range(b - a):
                text, own = texts[a + i], ids[starts[i] : starts[i + 1]]
                if unsure[i + 1] > unsure[i] or "\0" in text:
                    own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                yield np.append(own, np.uint32(end))


def encoder(path: str, rule: str) -> Encoder:
    """This worker's encoder."""
    return worker_cache(("tokens", path, rule), lambda: Encoder(path, rule))
