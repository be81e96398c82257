"""Exact token ids of whole texts, cached by pieces between blanks."""

from __future__ import annotations

import os
import re
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 300_000  # remembered at least; twice as many at most


class Encoder:
    """Ids of texts for a tokenizer that drops white space and never joins across it.

    Ids come from the tokenizers library; pieces between spaces and line breaks are
    encoded once and remembered: recent ones, in two generations of ``CACHE_PIECES``. Whether
    blanks matter is checked on creation: a tokenizer that keeps them is encoded text by text.

    Three rules, each checked on creation, save calls: case may not matter, a piece of
    letters followed by full stops or commas is the ids of both parts, and the last id of a
    word of letters is marked, so that many new words are encoded in one call; each word's share of the ids must
    have the word's bytes. Letters that normalisation changes, or whose lower case has other ids, are encoded as they stand.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        probe = "Ab c\n,d 12"
        apart = [i for p in re.split("[ \n]", probe) for i in self._plain(p)]
        self.by_piece = self._plain(probe) == apart
        self.lowers = self._plain("ÀBc") == self._plain("àbc")
        self.splits = self._plain("abc.,") == self._plain("abc") + self._plain(".,")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.size = np.zeros(len(self.last), np.int64)  # bytes of an id: vocabularies write one letter for each
        for t, i in vocabulary.items():
            self.size[i] = len(t.removesuffix("</w>"))
        cased = [c for c in map(chr, range(0x110000)) if c.isalpha() and c.lower() != c]
        self.odd = frozenset("Σİ" + "".join(c for c in cased if self.lowers and self._plain(c) != self._plain(c.lower())))  # Σ and İ change case by context or length
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._plain(text), self.dtype).tobytes()

    def _learn_words(self, fresh: list[str]) -> None:
        """Encode new words of letters together, cut after the marked ids, if every cut has the bytes of its word."""
        for i in range(0, len(fresh), 4000):
            group = fresh[i : i + 4000]
            ids = np.array(self._plain(" ".join(group)), np.int64)
            cut = np.flatnonzero(self.last[ids]) + 1
            fits = len(cut) == len(group) and cut[-1] == len(ids)
            if fits:
                bytes_of = np.add.reduceat(self.size[ids], np.concatenate([[0], cut[:-1]]))
                fits = bool((bytes_of == np.array([len(w.encode()) for w in group])).all())
            if not fits:
                self.cache.update((w, self._bytes(w)) for w in group)
                continue
            data, start = ids.astype(self.dtype).tobytes(), 0
            for word, end in zip(group, (cut * self.dtype.itemsize).tolist()):
                self.cache[word] = data[start:end]
                start = end

    def _stable(self, base: str) -> bool:
        """Whether letters and their lower case are left alone by normalisation and have the same ids."""
        return is_normalized("NFC", base) and is_normalized("NFC", base.lower()) and self.odd.isdisjoint(base)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, older, splits, lowers, stable = self.cache, self.older, self.splits, self.lowers, self._stable
        fresh, keys, tails = {}, [], []
        for p in pieces:
            base = p.rstrip(".,") if splits else p
            if base.isalpha() and (base.isascii() or stable(base)):
                key = base.lower() if lowers else base
                tail = p[len(base) :]
            else:
                key, tail, base = p, "", ""
            if key not in cache:
                if key in older:
                    cache[key] = older[key]
                elif base:
                    fresh[key] = None
                else:
                    cache[key] = self._bytes(key)
            keys.append(key)
            tails.append(tail)
        self._learn_words(list(fresh))
        ends = {t: self._bytes(t) for t in set(tails)}
        return [cache[k] + ends[t] if t else cache[k] for k, t in zip(keys, tails)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the boundaries (len + 1)."""
        n = len(texts)
        if not self.by_piece:
            each = [np.array(self._plain(t or ""), self.dtype) for t in texts.to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
            return (np.concatenate(each) if each else np.zeros(0, self.dtype)), bounds
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        cut = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        length = size[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(first[at] - (ends - length), length)
        bounds = np.concatenate([[0], ends])[cut - cut[0]] if n else np.zeros(1, np.int64)
        return flat[take], bounds


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder for a file; kept between tasks."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
