"""Substring deduplication by recompression.

Words are named by hash, so a name is the same in every text. Two rounds each name runs of one
symbol and then pairs of symbols (a pair is named when the first symbol's coin is 0 and the
second's is 1), as long as the new symbol spans at most 2, then 4 words. Whether two symbols are
joined depends on them and a bounded neighbourhood alone: of equal windows of 50 words, all symbols
that start 12 or more words from either end are equal. The least of these symbols, by name, is the
window's anchor, so equal windows have the same anchor at the same place; the 24 words around it,
which lie inside the window too, make its key.

1. Each text gives its anchors' keys; Spark groups them, and a key of one document alone is done.
2. Only documents with shared keys are read again. The windows with one anchor make a block; equal
   blocks (128-bit names of all their words) are grouped, and all windows of a block that a document
   with a smaller doc_id has too are repeats at once. A hot passage is one row from here on.
3. Of the blocks left, those whose key has several different ones give their windows; Spark groups
   these by the 128-bit names of their words and finds for each the smallest doc_id it starts in.
4. Repeated windows mark their words; the documents' kept words are joined again.

Texts with the same words are one text from the start: all but the first lose every word if they have
50 or more.

Defined results: null or empty text has no words; a null doc_id loses nothing and takes nothing
from others; repeated rows (equal doc_id and words) have equal results and take nothing from each
other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import BROADCAST_IDS, bounded_batches, columns, materialize, only_with, quoted, small, with_batches
from almanac.llm.words import C1, Group, digest, groups, join, mix, sequences, split

WINDOW = 50
#: Most words of a symbol of each round.
SPANS = (2, 4)
#: Words at either end of a window whose symbols may differ: each round loses a run and a symbol.
MARGIN = 2 * sum(SPANS)
PLACE_BITS = 28


def symbols(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the texts' symbols after all rounds."""
    name = g.names
    start = np.arange(len(name))
    doc = np.repeat(np.arange(len(g.words)), g.sizes)
    for level, most in enumerate(SPANS):
        end = np.r_[start[1:], len(doc)]
        same = np.r_[False, (name[1:] == name[:-1]) & (doc[start[1:]] == doc[start[:-1]])] if len(name) else np.zeros(0, bool)
        head = np.flatnonzero(~same)
        size = np.diff(np.r_[head, len(name)])
        words = end[np.r_[head[1:], len(name)] - 1] - start[head] if len(head) else np.zeros(0, int)
        joined = (size > 1) & (words <= most)
        keep = ~same | ~np.repeat(joined, size)
        run = np.zeros(len(name), np.uint64)
        run[head] = np.where(joined, size, 0)
        name = np.where(run > 0, mix(name * C1 + run + np.uint64(level + 11)), name)[keep]
        start = start[keep]

        end = np.r_[start[1:], len(doc)]
        coin = (mix(name + np.uint64(level + 101)) >> np.uint64(63)).astype(bool)
        first = np.zeros(len(name), bool)
        first[:-1] = ~coin[:-1] & coin[1:] & (doc[start[:-1]] == doc[start[1:]]) & (end[1:] - start[:-1] <= most)
        at = np.flatnonzero(first)
        name = name.copy()
        name[at] = join(name[at], name[at + 1], level + 1001)
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start = name[keep], start[keep]
    return start, name


def anchors(g: Group, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a group of texts (by first word) the place of their anchor; the first
    words of the windows; the key of each place that is an anchor (0 elsewhere)."""
    n = int(g.starts[-1])
    if n >= 1 << PLACE_BITS:
        raise ValueError("a text of over 2**28 words")
    starts = [np.arange(a, b - window + 1) for a, b in zip(g.starts[:-1], g.starts[1:], strict=True) if b - a >= window]
    if not starts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(n, np.int64)
    first = np.concatenate(starts)
    place, name = symbols(g)
    low = np.uint64(PLACE_BITS)
    order = np.full(n, ~np.uint64(0), np.uint64)
    order[place] = mix(name + np.uint64(7)) >> low << low | place.astype(np.uint64)
    width = window - 2 * MARGIN - max(SPANS) + 1  # places where a symbol may start
    block, span = order, 1
    while 2 * span <= width:
        block = np.minimum(block[:-span], block[span:])
        span *= 2
    lo = first + MARGIN
    least = np.minimum(block[lo], block[lo + width - span])
    chosen = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    around = sequences(g.names, 2 * MARGIN, salt=5)
    key = np.zeros(n, np.int64)
    own = np.unique(chosen)
    key[own] = around[own - MARGIN].view(np.int64)
    return chosen, first, key


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def describe(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, digest (of the words), tag, whole (their SHA-256) and the anchors' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            sizes, digests, tags, whole, keys = [], [], [], [], []
            for g in groups(texts):
                chosen, first, key = anchors(g, window)
                ends = np.searchsorted(first, g.starts)
                for k, words in enumerate(g.words):
                    sizes.append(len(words))
                    digests.append(digest(g.names[g.starts[k] : g.starts[k + 1]]))
                    tags.append(int.from_bytes(digests[-1][:8], "little", signed=True))
                    whole.append(sha256(words))
                    keys.append(np.unique(key[chosen[ends[k] : ends[k + 1]]]))
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tags, pa.int64()), pa.array(whole, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "digest", "tag", "whole", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_words long, digest binary, tag long, whole string, keys array<long>")


def tag(names: np.ndarray) -> int:
    """With the doc_id it tells texts apart, also those of rows that share a doc_id."""
    return int.from_bytes(digest(names)[:8], "little", signed=True)


def shared_blocks(texts: DataFrame, window: int) -> DataFrame:
    """For each anchor with a shared key: doc_id, tag, key, the block's two names, its first window and
    the number of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, body, wanted = columns(batch, "doc_id", "text", "keys")
            out: dict[str, list] = {k: [] for k in ("doc_id", "tag", "key", "h", "i", "at", "m")}
            for g in groups(body):
                chosen, first, key = anchors(g, window)
                ends = np.searchsorted(first, g.starts)
                for k in range(g.first, g.last):
                    base = int(g.starts[k - g.first])
                    own, at = chosen[ends[k - g.first] : ends[k - g.first + 1]], first[ends[k - g.first] : ends[k - g.first + 1]]
                    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
                    size = np.diff(np.r_[head, len(own)])
                    good = np.isin(key[own[head]], np.array(wanted[k], np.int64))
                    text = tag(g.names[base : g.starts[k - g.first + 1]])
                    for h, n in zip(head[good].tolist(), size[good].tolist(), strict=True):
                        a = int(at[h])
                        name = digest(g.names[a : a + n - 1 + window])
                        out["doc_id"].append(ids[k])
                        out["tag"].append(text)
                        out["key"].append(int(key[own[h]]))
                        out["h"].append(int.from_bytes(name[:8], "little", signed=True))
                        out["i"].append(int.from_bytes(name[8:], "little", signed=True))
                        out["at"].append(a - base)
                        out["m"].append(n)
            kinds = {"at": pa.int32(), "m": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return texts.select("doc_id", "text", "keys").mapInArrow(run, "doc_id long, tag long, key long, h long, i long, at int, m int")


def single_windows(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, tag and for each window of the blocks in ``blocks`` (at, m) its two names and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, body, blocks = columns(batch, "doc_id", "tag", "text", "blocks")
            out: dict[str, list] = {k: [] for k in ("doc_id", "tag", "h", "i", "at")}
            for g in groups(body):
                one, two = sequences(g.names, window, salt=17), sequences(mix(g.names + np.uint64(3)), window, salt=29)
                for k in range(g.first, g.last):
                    base = int(g.starts[k - g.first])
                    at = np.concatenate([np.arange(b["at"], b["at"] + b["m"]) for b in blocks[k]])
                    out["doc_id"].append(ids[k])
                    out["tag"].append(tags[k])
                    out["h"].append(one[base + at].view(np.int64))
                    out["i"].append(two[base + at].view(np.int64))
                    out["at"].append(at.astype(np.int32))
            kinds = {"h": pa.list_(pa.int64()), "i": pa.list_(pa.int64()), "at": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    rows = texts.select("doc_id", "tag", "text", "blocks").mapInArrow(run, "doc_id long, tag long, h array<long>, i array<long>, at array<int>")
    return rows.select("doc_id", "tag", F.explode(F.arrays_zip("h", "i", "at")).alias("w")).select("doc_id", "tag", "w.h", "w.i", "w.at")


def cut(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, n_removed, kept_sha256 and kept (the words left), from text and ``spans`` (first
    window, number of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, body, spans = columns(batch, "doc_id", "tag", "text", "spans")
            removed_, hashes, left_ = [], [], []
            for text, own in zip(body, spans, strict=True):
                words = split(text, lower=False)
                edges = np.zeros(len(words) + 1, np.int64)
                for s in own:
                    edges[s["at"]] += 1
                    edges[s["at"] + s["m"] - 1 + window] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                left = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                removed_.append(int(gone.sum()))
                hashes.append(sha256(left))
                left_.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(removed_, pa.int64()), pa.array(hashes, pa.string()), pa.array(left_, pa.string())], names=["doc_id", "tag", "n_removed", "kept_sha256", "kept"])

    return texts.select("doc_id", "tag", "text", "spans").mapInArrow(run, "doc_id long, tag long, n_removed long, kept_sha256 string, kept string")


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(about, partly): one row per document with doc_id, n_words, digest, tag, whole and ``gone`` (all its
    words are removed); and the documents that lose some words, as made by ``cut``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = materialize(describe(docs, window), "anchors")
    real = about.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    copies = real.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = materialize(copies.select("digest", "first"), "copies")
    texts = real.join(small(copies), "digest", "left").where("first is null or first = doc_id").select("doc_id", "tag", "keys")
    rows = texts.select("doc_id", "tag", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    per_text = rows.join(shared, "key").groupBy("doc_id", "tag").agg(F.collect_set("key").alias("keys"))  # a text's own anchors
    wanted = materialize(per_text, "shared")
    some = with_tag(only_with(docs, wanted.select("doc_id").distinct(), ["doc_id"]))
    some = materialize(some.join(wanted, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]), "texts")

    blocks = materialize(shared_blocks(some, window), "blocks")
    least = materialize(blocks.groupBy("h", "i").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "i", "lo"), "block-firsts")
    placed = materialize(blocks.join(least, ["h", "i"], "left"), "placed")
    whole = placed.where("lo < doc_id").select("doc_id", "tag", "at", "m")
    heads = placed.where("lo is null or lo = doc_id")
    several = heads.select("key", "h", "i").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    unsure = heads.join(several, "key").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "m")).alias("blocks"))
    windows = materialize(single_windows(some.drop("keys").join(unsure, ["doc_id", "tag"]), window), "windows")
    first = windows.groupBy("h", "i").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "i", "lo")
    first = materialize(first, "window-firsts")
    marked = windows.join(first, ["h", "i"]).where("lo < doc_id").select("doc_id", "tag", "at", F.lit(1).alias("m"))
    spans = marked.unionByName(whole).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "m")).alias("spans"))
    partly = cut(some.join(spans, ["doc_id", "tag"]), window)
    gone = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)) & (F.col("n_words") >= window)
    about = about.drop("keys").join(copies, "digest", "left").withColumn("gone", gone).drop("first")
    return about, materialize(partly, "cut")


def with_tag(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            tags = [tag(g.names[a:b]) for g in groups(texts) for a, b in zip(g.starts[:-1], g.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(tags, pa.int64())], names=["doc_id", "text", "tag"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, tag long")


EMPTY = hashlib.sha256(b"").hexdigest()


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    about, partly = repeats(docs, window)
    out = about.join(partly.drop("kept"), ["doc_id", "tag"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept words as text where words are removed; other rows and columns (but for
    n_chars, if there is one) as they are."""
    about, partly = repeats(docs, window)
    gone = about.where("gone").select("doc_id", "tag", F.lit("").alias("kept"))
    new = materialize(partly.select("doc_id", "tag", "kept").unionByName(gone).distinct(), "new-texts")
    ids = new.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    text = docs.schema["text"].dataType
    keyed = docs.join(ids, "doc_id", "left_semi")
    names = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            tags = [tag(g.names[a:b]) for g in groups(batch.column(at).to_pylist()) for a, b in zip(g.starts[:-1], g.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.int64())], names=[*batch.schema.names, f"c{len(batch.schema.names)}"])

    keyed = with_batches(keyed, run, "__tag")
    new = new.toDF("__id", "__key", "__new")
    kept = F.col("__new")
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__key"))
    values = quoted(*docs.columns)
    for k, c in enumerate(docs.columns):
        if c == "text":
            values[k] = F.coalesce(kept, F.col(c)).cast(text).alias(c)
        elif c == "n_chars":
            values[k] = F.when(kept.isNotNull(), F.char_length(kept)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    changed = keyed.join(new, same, "left").select(*values)
    return docs.join(ids, "doc_id", "left_anti").select(*quoted(*docs.columns)).unionByName(changed)
