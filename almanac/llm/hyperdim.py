"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of -1 and +1, drawn from its code point. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place. A text's vector
bundles (adds) its n-grams' vectors, a language's prototype those of its labelled texts. A text
gets the language whose prototype has the largest cosine with it.

Texts are read as lower-case letters, with one space for each run of other characters.

Defined results: a text that is null or has no letter is ``und`` with score 0; labels are null-safe
(rows without text or label teach nothing); equal cosines go to the first label in order; without
any labelled text all rows are ``und``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import bounded_batches, columns

DIM, N = 1024, 3
#: Characters whose n-grams are counted together.
COUNTED_CHARS = 1_000_000
#: Texts whose vectors are made together.
TOGETHER = 64
#: N-grams whose vectors are multiplied at once, and letters whose vectors are kept: a text of any length
#: and any script takes bounded memory but for its own n-grams' numbers.
BLOCK, LETTERS = 4096, 30_000

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    return np.random.default_rng([code, dim]).integers(0, 2, dim, dtype=np.int8) * 2 - 1


class Grams:
    """Vectors of n-grams, made when first met and kept in a bounded table."""

    def __init__(self, dim: int, n: int, keep: int = 60_000):
        self.dim, self.n, self.keep = dim, n, keep
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((1024, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters = {}
            self.letters[code] = letter_vector(code, self.dim)
        return self.letters[code]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """(k, n) code points -> (k, dim), from the letters."""
        codes, at = np.unique(grams, return_inverse=True)
        letters, at = np.stack([self.letter(c) for c in codes.tolist()]), at.reshape(grams.shape)
        out = np.ones((len(grams), self.dim), np.int8)
        for place in range(self.n):
            out *= np.roll(letters, self.n - 1 - place, axis=1)[at[:, place]]
        return out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """(k, n) code points, all different -> (k, dim)"""
        if len(self.rows) + len(grams) > self.keep:
            self.rows = {}
        keys = list(map(tuple, grams.tolist()))
        new = [k for k, gram in enumerate(keys) if gram not in self.rows]
        if new:
            first = len(self.rows)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = self.bound(grams[new])
            self.rows.update((keys[k], first + j) for j, k in enumerate(new))
        return self.table[[self.rows[gram] for gram in keys]]


def counts(texts: list[str | None], n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of texts: first and last + 1 of the group, the distinct n-grams as code points
    (k, n), and for each (text of the group, n-gram) that occurs three rows: text, gram, count."""
    table = letter_table()
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and k - first < TOGETHER and (size == 0 or size < COUNTED_CHARS):
            size += len(texts[k] or "")
            k += 1
        joined = " ".join(f" {t or ''} " for t in texts[first:k])  # no n-gram of a text reaches into another
        codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(k - first), [len(t or "") + 2 + (i < k - first - 1) for i, t in enumerate(texts[first:k])])
        keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])]
        codes, owner = codes[keep], owner[keep]
        symbols, at = np.unique(codes, return_inverse=True)
        base = len(symbols)
        m = len(at) - n + 1
        if m <= 0:
            yield first, k, np.zeros((0, n), np.int64), np.zeros((3, 0), np.int64)
            continue
        key = np.zeros(m, np.int64)
        for place in range(n):
            key = key * base + at[place : place + m]
        whole = owner[:m] == owner[n - 1 :]
        key, own = key[whole], owner[:m][whole]
        middle = codes[n // 2 : n // 2 + m][whole] != 0  # a letter in the middle
        key, own = key[middle], own[middle]
        pairs, number = np.unique(own * base**n + key, return_counts=True)
        grams, gram = np.unique(pairs % base**n, return_inverse=True)
        parts = np.stack([grams // base ** (n - 1 - place) % base for place in range(n)], 1) if len(grams) else np.zeros((0, n), np.int64)
        yield first, k, symbols[parts].astype(np.int64), np.stack([pairs // base**n, gram, number])


def bundle(texts: list[str | None], grams: Grams) -> np.ndarray:
    """The texts' vectors (float32); a text without a letter has the zero vector."""
    out = np.zeros((len(texts), grams.dim), np.float32)
    for first, last, codes, (text, gram, number) in counts(texts, grams.n):
        order = np.argsort(gram, kind="stable")
        text, gram, number = text[order], gram[order], number[order]
        for a in range(0, len(codes), BLOCK):
            block = codes[a : a + BLOCK]
            i, j = np.searchsorted(gram, (a, a + len(block)))
            weights = np.zeros((last - first, len(block)), np.float32)
            weights[text[i:j], gram[i:j] - a] = number[i:j]
            out[first:last] += weights @ grams.vectors(block).astype(np.float32)
    return out


def prototypes(docs: DataFrame, label: str = "lang", dim: int = DIM, n: int = N) -> dict[str, np.ndarray]:
    """Each label's prototype, from all rows with text and label. The driver gets a vector a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(dim, n), {}
        for batch in batches:
            texts, labels = columns(batch, "text", "label")
            for name in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == name]
                for first, last, codes, (_, gram, number) in counts(own, n):
                    total = np.bincount(gram, number, len(codes))
                    for a in range(0, len(codes), BLOCK):
                        vectors = grams.vectors(codes[a : a + BLOCK])
                        sums[name] = sums.get(name, 0) + total[a : a + BLOCK] @ vectors.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["label", "v"])

    known = docs.select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    bounded_batches(docs.sparkSession)
    rows = known.mapInArrow(run, "label string, v array<long>").select("label", F.posexplode("v").alias("i", "x"))
    summed = rows.groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["label"]: np.array([x["x"] for x in r["v"]], np.float64) for r in summed.collect()}


def classify(docs: DataFrame, learned: dict[str, np.ndarray], dim: int = DIM, n: int = N) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of every row."""
    names = sorted(learned)
    matrix = np.zeros((dim, len(names)), np.float32)
    for k, name in enumerate(names):
        matrix[:, k] = learned[name] / max(np.linalg.norm(learned[name]), 1e-30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dim, n)
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            v = bundle(texts, grams)
            norm = np.linalg.norm(v, axis=1)
            cosine = v @ matrix / np.maximum(norm, 1e-30)[:, None]
            best = cosine.argmax(1) if names else np.zeros(len(texts), int)
            found = [names[b] if names and length > 0 else "und" for b, length in zip(best, norm, strict=True)]
            score = [float(min(1.0, max(0.0, cosine[i, b]))) if found[i] != "und" else 0.0 for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that teach nothing: crc32 of the id as text is divisible by ``folds``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, label: str = "lang") -> DataFrame:
    learned = prototypes(docs.where(~held_out(F.col("doc_id"))), label)
    return classify(docs, learned).withColumn("held_out", held_out(F.col("doc_id")))
