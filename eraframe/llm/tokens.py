"""Token ids of whole texts, with every distinct word encoded once per worker."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

# Distinct words that a worker remembers, and how many of them it keeps when they are too many:
# those that came up first, among which are the frequent ones.
_REMEMBERED = 500_000
_KEPT = 200_000
# Characters of texts that are worked on at a time.
_AT_ONCE = 2_000_000
_PLAIN = re.compile(rb"[a-z]+")
_CLOSED = re.compile(rb"([a-z]+)([.,])")


class _WordIds(dict):
    """Ids of words as one flat array, and the number of each word in it.

    The tokenizer never joins characters across ASCII white space, gives blanks no ids,
    and reads A-Z as a-z; words are kept in that form, but for those that could be one of
    its special tokens, which only match as they are written.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: list[bytes] = []
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.stops = np.zeros(1 << 14, dtype=np.int64)  # where each word's ids end

    def forget(self) -> None:
        """Drops the words that came up after the first ``_KEPT`` ones."""
        kept = list(itertools.islice(self.items(), _KEPT))
        self.clear()
        self.update(kept)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def _encode(self, word: bytes) -> list[int]:
        if _PLAIN.fullmatch(word):  # one run of letters, nothing to normalise
            return [token.id for token in self.model.tokenize(word.decode())]
        closed = _CLOSED.fullmatch(word)
        if closed:  # a run of letters and a run of one mark
            return self._encode(closed[1]) + self._encode_any(closed[2])
        return self._encode_any(word)

    def _encode_any(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def learn(self) -> None:
        """Encodes the words that came up since the last call."""
        if not self.new:
            return
        ids = [self._encode(word) for word in self.new]
        first = len(self) - len(ids)
        begin = int(self.stops[first - 1]) if first else 0
        stops = begin + np.cumsum([len(i) for i in ids])
        while len(self.stops) < len(self):
            self.stops = np.concatenate([self.stops, np.zeros_like(self.stops)])
        while len(self.flat) < stops[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[begin : stops[-1]] = [i for part in ids for i in part]
        self.stops[first : len(self)] = stops
        self.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > _REMEMBERED:
            self.forget()
        words: list[bytes] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            raw = text.encode()
            words += (raw if b"<|" in raw else raw.lower()).split()
            ends[i] = len(words)
        if not words:
            return np.zeros(0, dtype=np.uint32), ends
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.learn()
        begins = np.where(number > 0, self.stops[number - 1], 0)
        sizes = self.stops[number] - begins
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(begins - (stops - sizes), sizes)
        return self.flat[at], np.concatenate([[0], stops])[ends]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to all their ids and the end of each text in them."""
    return _WordIds(path).encode


def in_parts(batch: pd.DataFrame, at_once: int = _AT_ONCE) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows of about ``at_once`` characters; null texts as empty."""
    batch = batch.assign(text=batch["text"].fillna(""))
    size = batch["text"].str.len().to_numpy()
    part = (np.cumsum(size) - size) // at_once
    for _, rows in batch.groupby(part, sort=True):
        yield rows
