"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary's byte strings (hash and displace: buckets of
keys, largest first, each with the first displacement that sends its keys to free slots; buckets of
one key store their slot) finds pre-tokens that are tokens already; the slot's own key is compared.
Tier 2: other pre-tokens start as a linked list of bytes; a heap of (rank, position) gives the next
merge, and merged neighbours push their new pairs.

Defined results: null and empty text have no ids (sha256 of nothing); repeated rows and null ids are
encoded like all others. Texts are whole, whatever their length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import bounded_batches, columns

#: White space as the library's patterns see it (the Unicode property White_Space). Fixed values.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of most words here, before a place where both vocabularies always cut.
LETTERS = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]+(?=[!-@\\[-`{-~" + WHITE + "]|\\Z)"
#: Chunks of text (a word, or marks, with the space before) whose ids a worker remembers.
CACHE_CHUNKS = 500_000
KEYS_IN_BUCKET = 3
MASK, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Slots 0..n-1 for n distinct keys; ``index(key)`` is the key's number, or -1 for other keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // KEYS_IN_BUCKET)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, (bucket, _) in enumerate(hashes):
            members[bucket].append(i)
        self.displace = np.zeros(self.buckets, np.int64)  # or -1 - slot, for a bucket of one key
        number = np.full(n, -1, np.int64)
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(hashes[i][1], d) for i in own}
                if len(slots) == len(own) and all(number[s] < 0 for s in slots):
                    break
                d += 1
            self.displace[bucket] = d
            for i in own:
                number[self._slot(hashes[i][1], d)] = i
        free = iter(np.flatnonzero(number < 0).tolist())
        for bucket, own in enumerate(members):
            if len(own) == 1:
                slot = next(free)
                self.displace[bucket] = -1 - slot
                number[slot] = own[0]
        self.number = number.tolist()
        self.displace = self.displace.tolist()
        self.key = [keys[i] for i in self.number]

    def _hash(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & MASK) % self.buckets, h >> 64

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * MIX) * MIX & MASK) >> 20) % self.n

    def index(self, key: bytes) -> int:
        bucket, h = self._hash(key)
        d = self.displace[bucket]
        slot = -1 - d if d < 0 else self._slot(h, d)
        return self.number[slot] if self.key[slot] == key else -1


class BytePairs:
    """Encoder and decoder for a rank file and a pattern that finds pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.keys = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.hash = PerfectHash(self.keys)
        self.token = dict(zip(self.ids, self.keys, strict=True))
        self.pre_tokens = regex.compile(pattern).findall
        self.chunks = regex.compile(f" ?{LETTERS}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Tier 2: repeatedly the pair of least rank, leftmost first."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts at a position; 0 once merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = after[i]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        i = self.hash.index(piece)
        return self.merge(piece) if i < 0 else [self.ids[i]]

    def encode_chunk(self, chunk: str) -> bytes:
        ids = list(chain.from_iterable(self.encode_piece(p.encode()) for p in self.pre_tokens(chunk)))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes. The pattern always cuts before a run of white
        space and between a letter and a mark, so the text may be cut there first and the ids of
        frequent chunks be remembered."""
        chunks = self.chunks(text or "")
        found = list(map(self.cache.get, chunks))
        if None in found:
            if len(self.cache) > CACHE_CHUNKS:
                self.cache, self.older = {}, self.cache
            for i, x in enumerate(found):
                if x is None:
                    chunk = chunks[i]
                    found[i] = self.cache[chunk] = self.cache.get(chunk) or self.older.get(chunk) or self.encode_chunk(chunk)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(ranks_path: str, pattern: str) -> BytePairs:
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = BytePairs(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([bpe.encode(t) for t in texts], pa.binary())], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bpe.decode(x or b"") for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """n_tokens and the digests of the ids and of the bytes decoded from them."""
    out = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


