"""64-bit names of words and of word sequences, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: Odd constants of the mixing steps.
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of the texts that are handled together.
TOGETHER = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The name of the sequence a then b."""
    return mix(a * C1 + b + np.uint64(salt))


def sequences(names: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The names of all windows of ``length`` names, by doubling."""
    n = len(names) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, block, span, taken = None, names, 1, 0
    while span <= length:
        if length & span:
            part = block[taken : taken + n]
            out = part if out is None else join(out, part, salt + 1)
            taken += span
        if 2 * span <= length:
            block = join(block[:-span], block[span:], salt)
        span *= 2
    return out


@dataclass
class Group:
    """Texts first..last - 1 of a batch: their words, the words' names, and where each text starts."""

    first: int
    last: int
    words: list[list[bytes]]
    names: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def split(text: str | None, lower: bool) -> list[bytes]:
    """Words between space and \\t \\n \\v \\f \\r; ``lower`` puts A-Z in lower case."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def groups(texts: list[str | None], lower: bool = False) -> Iterator[Group]:
    k = 0
    while k < len(texts):
        first, words, total = k, [], 0
        while k < len(texts) and total < TOGETHER:
            words.append(split(texts[k], lower))
            total += len(words[-1])
            k += 1
        flat = (xxhash.xxh3_64_intdigest(w) for own in words for w in own)
        yield Group(first, k, words, np.fromiter(flat, np.uint64, total), np.cumsum([0, *map(len, words)]))


def digest(names: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(names.tobytes())
