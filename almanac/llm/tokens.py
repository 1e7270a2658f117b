"""Token ids of whole texts by the ``tokenizers`` library, cached by word.

Both vocabularies never merge across the start of a white-space run or from a letter to
a mark, so the ids of a text are those of its words (white space first) and of the marks after them,
one after the other. The cuts are found on the bytes of many texts at once, Arrow numbers the
distinct words, and each of these goes to the library once while it is in the worker's bounded cache.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from almanac.llm.util import columns

#: Bytes of the texts that are handled together, but for one longer text.
TOGETHER = 8 << 20
#: Words cached by a worker; the cache keeps one older generation.
CACHE_WORDS = 600_000
#: Longer words are not cached.
LONGEST = 64

OTHER, WHITE, LETTER, MARK, HIGH = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[[*range(0x09, 0x0E), 0x20]] = WHITE
KIND[0x80:] = HIGH


def ends_white(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at the bytes ``at`` is white space outside ASCII (the Unicode
    property White_Space). Two characters of other lengths that end alike only lose a cut."""
    last, second, third = b[at], b[np.maximum(at - 1, 0)], b[np.maximum(at - 2, 0)]
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    e2 = (third == 0xE2) & (((second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))) | ((second == 0x81) & (last == 0x9F)))
    return two | e2 | ((third == 0xE1) & (second == 0x9A) & (last == 0x80)) | ((third == 0xE3) & (second == 0x80) & (last == 0x80))


def cuts(b: np.ndarray) -> np.ndarray:
    """True where a word or the marks after one start."""
    kind = KIND[b]
    now, prev = kind[1:], kind[:-1]
    out = np.ones(len(b), bool)
    out[1:] = ((now == WHITE) & (prev != WHITE)) | ((now == MARK) & (prev == LETTER))
    unsure = np.flatnonzero(out[1:] & (prev == HIGH))
    if len(unsure):
        out[unsure[ends_white(b, unsure)] + 1] = False
    return out


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cached: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cached = cached
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        k = 0
        while k < len(texts):
            raw: list[bytes] = []
            size = 0
            while k < len(texts) and (not raw or size < TOGETHER):
                raw.append((texts[k] or "").encode())
                size += len(raw[-1])
                k += 1
            yield from self._together(raw)

    def _together(self, raw: list[bytes]) -> Iterator[bytes]:
        data = b"".join(raw)
        edges = np.cumsum([0, *map(len, raw)])
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            yield from [b""] * len(raw)
            return
        start = cuts(b)
        start[edges[:-1][edges[:-1] < len(b)]] = True
        at = np.flatnonzero(start)
        offsets = np.r_[at, len(b)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = size[code]
        ends = np.cumsum(n)
        moved = (np.cumsum(size) - size)[code] - (ends - n)
        out = flat[np.repeat(moved, n) + np.arange(ends[-1])].tobytes()
        first = np.r_[0, ends][np.searchsorted(at, edges)].tolist()
        for i, j in zip(first, first[1:], strict=False):
            yield out[4 * i : 4 * j]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Each of these distinct words' ids."""
        if len(self.cache) > self.cached:  # words in use come back from the older half
            self.cache, self.older = {}, self.cache
        out = list(map(self.cache.get, words))
        lacking = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in lacking:
            if (x := self.older.get(words[i])) is None:
                new.append(i)
            else:
                out[i] = self.cache[words[i]] = x
        for k in range(0, len(new), 1000):
            part = new[k : k + 1000]
            e = self.tokenizer.encode([words[i].decode() for i in part], is_pretokenized=True, add_special_tokens=False)  # each word on its own
            raw = np.array(e.ids, "<u4").tobytes()
            at = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            for i, a, b in zip(part, at, at[1:], strict=False):
                out[i] = raw[a:b]
                if len(words[i]) <= LONGEST:
                    self.cache[words[i]] = raw[a:b]
        return out


_encoders: dict[tuple[str, int], WordEncoder] = {}


def gathered(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[tuple[list, list]]:
    """doc_id and text of so many batches that their texts are about ``together`` bytes."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        of, text = columns(batch, "doc_id", "text")
        ids += of
        texts += text
        size += batch.nbytes
        if size >= together:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encoder(path: str, cached: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder for a vocabulary file, with a cache of ``cached`` words."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = WordEncoder(path, cached)
    return _encoders[path, cached]
