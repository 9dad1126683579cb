"""Token ids of texts by a public tokenizer, encoded once per distinct word.

The tokenizer's patterns never cross white space, so a text's ids are those of
its words one after another. A worker keeps the ids of words it has met (a cache
of bounded size, emptied when full) and assembles each text's ids by index.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from mensura.llm._text import Slice, hash_words

CACHE_WORDS = 3 << 19
LEARN_WORDS = 1 << 13
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.flat = np.zeros(1, np.int32), np.zeros(0, self.kind)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        sizes, parts = [], [self.flat]
        for at in range(0, len(words), LEARN_WORDS):  # what the tokenizer returns of a word takes far more room than its ids
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + LEARN_WORDS], add_special_tokens=False)]
            sizes += map(len, ids)
            parts.append(np.array(list(chain.from_iterable(ids)), self.kind))
        places = np.arange(len(keys), dtype=np.int32) + np.int32(len(self.keys))
        self.starts = np.concatenate([self.starts, (self.starts[-1] + np.cumsum(sizes, dtype=np.int64)).astype(np.int32)])
        self.flat = np.concatenate(parts)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.places = np.insert(self.keys, at, keys), np.insert(self.places, at, places)

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != hashes)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and for each text the index of its first one (rows + 1)."""
        starts, ends, first = s.words()
        hashes, index, back = np.unique(hash_words(s.data, starts, ends), return_index=True, return_inverse=True)
        new = self._unknown(hashes)
        if len(new) and len(self.keys) + len(new) > CACHE_WORDS:
            self.clear()  # then all words of the slice are learned, however many
            new = np.arange(len(hashes))
        if len(new):
            blob, a, b = s.data.tobytes(), starts[index[new]], ends[index[new]]
            self._learn(hashes[new], [blob[i:j].decode() for i, j in zip(a.tolist(), b.tolist())])
        at = np.searchsorted(self.keys, hashes)
        place = self.places[at] if len(hashes) else np.zeros(0, np.int32)
        begin = self.starts[place].astype(np.int64)
        size = self.starts[place + 1] - begin
        begin, size = begin[back], size[back]
        run = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - run[:-1], size) + np.arange(run[-1])].astype(np.uint32)
        return ids, run[first]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it outlives a task where workers are reused."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
