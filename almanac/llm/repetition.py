"""Quality rules on repetition, by suffix arrays over words.

The suffixes of each text (in words) are sorted by prefix doubling, many texts at once; suffixes
that differ from all others leave the sort early. Neighbours in the sorted order give the longest
common prefixes; a position whose prefix of at least ``min_repeat`` words occurs elsewhere in its
text starts a repeated substring, and the union of these spans is what the maximal repeats cover.
A text is rejected when they cover more than ``max_covered`` of its words or when one of them is
longer than ``max_longest`` of its words and ``min_longest`` words.

Base rules: fewer than 50 words, or over half of the words in 3-word windows that occur again.

Defined results: null or empty text has no words, counts of 0, and fails the base rules; rows are
judged on their own, so repeated rows and null ids make no difference; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import bounded_batches, columns, with_batches

MIN_WORDS, MAX_REPEATED = 50, 50
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MIN_LONGEST = 8, 0.3, 0.3, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Words of the texts that are sorted together.
SORTED_WORDS = 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def refine(rank: np.ndarray, live: np.ndarray, span: int, left: np.ndarray) -> np.ndarray:
    """Sort the suffixes ``live``, ordered and named by their first ``span`` words, by twice as
    many. A name is the number of suffixes before its first; a suffix that ends earlier comes first."""
    second = np.full(len(live), -1, np.int64)
    more = left[live] > span
    second[more] = rank[live[more] + span]
    order = np.lexsort((second, rank[live]))
    first, second = rank[live][order], second[order]
    index = np.arange(len(order))
    group = np.r_[True, first[1:] != first[:-1]]
    part = group | np.r_[True, second[1:] != second[:-1]]
    named = first + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
    out = rank.copy()
    out[live[order]] = named
    return out


def shared(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Those of ``live`` whose name another suffix has too."""
    counts = np.bincount(rank[live], minlength=1)
    return live[counts[rank[live]] > 1]


def suffixes(words: np.ndarray, doc: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the positions of many documents (word ids, document, words left to its end): whether the
    3-word window there occurs again in its document; and the length of the longest prefix that
    occurs again there, 0 where it is under ``least``."""
    n = len(words)
    triple, longest = np.zeros(n, bool), np.zeros(n, np.int64)
    if not n:
        return triple, longest
    _, inverse, counts = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, span, live, wanted = [rank], 1, shared(rank, np.arange(n)), None
    while len(live):
        if span <= least < 2 * span:
            wanted = live  # all that share at least ``span`` words
        rank = refine(rank, live, span, left)
        levels.append(rank)
        span *= 2
        live = shared(rank, live)
        if span == 2:
            pairs = live[left[live] >= 3]
            following = np.zeros(n, bool)
            following[live] = True
            pairs = pairs[following[pairs + 1]]
            if len(pairs):
                _, inverse, counts = np.unique(rank[pairs] * n + rank[pairs + 1], return_inverse=True, return_counts=True)
                triple[pairs] = counts[inverse] > 1
    if wanted is None or len(wanted) < 2:
        return triple, longest
    order = wanted[np.argsort(rank[wanted])]  # now all names differ
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels) - 1)):  # the last level has no shared name
        go = np.flatnonzero((left[a] - common >= 2**k) & (left[b] - common >= 2**k))
        go = go[levels[k][a[go] + common[go]] == levels[k][b[go] + common[go]]]
        common[go] += 2**k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return triple, longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions lie in a span [i, i + lengths[i])."""
    ends = np.arange(len(lengths)) + lengths
    return np.maximum.accumulate(ends) > np.arange(len(lengths)) if len(lengths) else np.zeros(0, bool)


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, list]:
    """The counts of COUNTS, n_covered and n_longest of each text."""
    out: dict[str, list] = {k: [] for k in (*COUNTS, "n_covered", "n_longest")}
    group: list[list[bytes]] = []

    def flush() -> None:
        sizes = np.array([len(w) for w in group], np.int64)
        flat = [w for words in group for w in words]
        names = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(flat))
        triple, longest = suffixes(ids, doc, left, min_repeat)
        windows = np.zeros(len(flat), np.int64)
        windows[triple] = 3
        in_windows, in_repeats = covered(windows), covered(longest)
        for a, b in zip(ends - sizes, ends, strict=True):
            out["n_repeat_words"].append(int(in_windows[a:b].sum()))
            out["n_covered"].append(int(in_repeats[a:b].sum()))
            out["n_longest"].append(int(longest[a:b].max(initial=0)))
        group.clear()

    total = 0
    for text in texts:
        text = text or ""
        words = text.encode().split()  # at space and \t \n \v \f \r only
        seen: set[str] = set()
        duplicates = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    duplicates += 1
                elif line.strip(SPACES):
                    seen.add(line)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(duplicates)
        group.append(words)
        total += len(words)
        if total >= SORTED_WORDS:
            flush()
            total = 0
    flush()
    return out


def judge(m: dict[str, list], max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, min_longest: int = MIN_LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of measured texts."""
    n, repeated, cover, longest = (np.array(m[k], np.int64) for k in ("n_words", "n_repeat_words", "n_covered", "n_longest"))
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
    repetitive = (cover > max_covered * n) | ((longest >= min_longest) & (longest > max_longest * n))
    return failed, ~failed & ~repetitive


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, min_longest: int = MIN_LONGEST) -> DataFrame:
    """One row per document: doc_id, the counts, n_covered and n_longest (words in maximal repeats,
    words of the longest), base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            m = measure(texts, min_repeat)
            failed, kept = judge(m, max_covered, max_longest, min_longest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(v, pa.int64()) for v in m.values()), pa.array(failed), pa.array(kept)], names=["doc_id", *m, "base_failed", "kept"]
            )

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in (*COUNTS, "n_covered", "n_longest")) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(measure(batch.column(at).to_pylist()))[1]))

    bounded_batches(docs.sparkSession)
    return with_batches(docs, run)
