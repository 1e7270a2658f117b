"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form each belongs to.

Of a pair one word contributes two disjoint chunks that cover it, the other its positional grams of
the chunks' lengths; one edit leaves one of the chunks whole, at its own place (an edit behind it)
or moved by the difference of the lengths, one at most (an edit before it). Many words can share a
half, so the other half, in which the edit lies, is divided by the same rule again: a key is all of
a word but one quarter. A pair then shares a key if and only if the words agree outside of that
quarter, and the join makes hardly more pairs than there are near words. Every word takes both
parts; of a pair the smaller word is the one with chunks. Candidates are verified by edit distance.

All of this is joins and sums: no group of words is ever gathered, no pair is left out.

Words are the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. The runs
of some documents lose one letter, fixed by a checksum of doc_id and run: planted misspellings.

Defined results: a null text has no runs; in a row with a null doc_id no run loses a letter; repeated
rows count each; words are case-sensitive beyond A-Z; of equally frequent near words the smallest in
code-point order is the form; an empty table gives no rows. Runs of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import bounded_batches, columns, materialize

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: A run loses a letter if this divides its checksum.
LOSES = 31
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """(word, n) of words with at least ``least`` letters."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        found: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                seed = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for word, k in Counter(runs((text or "").encode().lower().decode())).items():
                    if seed is not None and (h := zlib.crc32(word.encode(), seed)) % LOSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    found[word] = found.get(word, 0) + k
                if len(found) > HELD:
                    yield counted()
                    found = {}
        yield counted()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def without_quarter(word: Column, size: Column, quarter: int, shift: int) -> Column:
    """The key of ``word`` for words of ``size`` letters: all but one quarter, which is ``shift``
    letters longer here; with the quarter's number and the size."""
    first, last = F.floor(quarter * size / 4).cast("int"), F.floor((quarter + 1) * size / 4).cast("int")
    kept = F.concat(word.substr(F.lit(1), first), F.lit("\n"), word.substr(last + shift + 1, F.length(word)))
    return F.xxhash64(kept, size, F.lit(quarter))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): the pairs a < b of ``words`` (word, n) with edit distance one, each once."""
    word, size = F.col("word"), F.length("word")
    chunks = F.array(*(without_quarter(word, size, q, 0) for q in range(4)))
    grams = F.array(*(without_quarter(word, size - shift, q, shift) for q in range(4) for shift in (-1, 0, 1)))
    left = words.select(F.explode(chunks).alias("key"), word.alias("a"), F.col("n").alias("na"))
    right = words.select(F.explode(grams).alias("key"), word.alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "key").where("a < b").where(F.levenshtein("a", "b", 1) == 1)
    return pairs.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last one. Every round doubles the steps
    taken; counts grow tenfold with each step, so chains are short and have no circle."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = found.join(further, "root", "left")
        if not step.where("far is not null").limit(1).count():
            return found
        found = materialize(step.select("word", F.coalesce("far", "root").alias("root")), "roots")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. ``least_letters`` of at least 4."""
    bounded_batches(docs.sparkSession)
    words = materialize(count_words(docs, least_letters).where(F.col("n") >= least_count), "words")
    pairs = materialize(near_pairs(words), "near-words")
    each = pairs.select(F.col("a").alias("word"), F.col("nb").alias("m"), F.col("b").alias("near"))
    each = each.unionByName(pairs.select(F.col("b").alias("word"), F.col("na").alias("m"), F.col("a").alias("near")))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    has_form = -F.col("best.m") >= times * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n"))
    judged = materialize(judged, "forms")
    out = judged.join(roots(judged.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
