"""Packing by non-negative least squares over shallow length combinations.

Every document becomes token pieces of at most ``window`` ids: whole windows and one rest. Lengths
are rounded up to a grid of ``grain`` ids. All combinations of up to ``depth`` grid lengths, and of
two lengths repeated, that fill a window exactly are the columns of a matrix; non-negative least
squares finds how often to repeat each of them to use up the histogram of lengths. The repeat
counts are rounded down, what is left is packed greedily, largest first, on the histogram. Only the
histogram (one row for each grid length) and the plan (a row for each combination in use) pass
through the driver; pieces get their places from their rank within their length on the executors.

Defined results: null or empty text is one piece that holds the end id alone; rows with a null or
repeated doc_id are packed like all others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.tokens import CACHE_WORDS, TOGETHER, encoder, gathered
from almanac.llm.util import bounded_batches, materialize

WINDOW, GRAIN, DEPTH, END_ID = 4096, 16, 3, 2
#: Pieces ranked together within one length class.
RANKED = 50_000


def pieces(docs: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, together: int = TOGETHER, cached: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids). A worker encodes texts of
    ``together`` bytes at once and caches ``cached`` words; smaller ones take less memory, not other ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, cached)
        for ids, texts in gathered(batches, together):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, raw in zip(ids, enc.encode(texts), strict=True):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start : 4 * (start + window)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(n)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def combinations(bins: int, depth: int = DEPTH) -> list[dict[int, int]]:
    """Combinations {length: count} that fill ``bins`` exactly: up to ``depth`` lengths, or two
    lengths each any number of times."""
    found: set[tuple[tuple[int, int], ...]] = set()

    def add(parts: list[int]) -> None:
        found.add(tuple(sorted({x: parts.count(x) for x in parts}.items())))

    def grow(parts: list[int], left: int) -> None:
        last = parts[-1] if parts else bins
        if 0 < left <= last:
            add([*parts, left])
        if len(parts) + 2 <= depth:
            for x in range(min(last, left - 1), 0, -1):
                grow([*parts, x], left - x)

    grow([], bins)
    for a in range(1, bins):
        for n in range(1, bins // a + 1):
            rest = bins - n * a
            if not rest:
                found.add(((a, n),))
            for b in range(a + 1, rest + 1):
                if rest % b == 0:
                    found.add(((a, n), (b, rest // b)))
    return [dict(x) for x in sorted(found)]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """argmin |a x - b| over x >= 0 (active sets after Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    barred = np.zeros(n, bool)
    for _ in range(3 * max(a.shape)):
        w = a.T @ (b - a @ x)
        w[active | barred] = -np.inf
        if not n or w.max() <= tolerance:
            break
        active[j := int(w.argmax())] = True
        first = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if first and s[np.searchsorted(idx, j)] <= tolerance:  # rounding: this column can't enter
                active[j], barred[j] = False, True
                break
            first = False
            if (s > 0).all():
                x[:], barred[:] = 0, False
                x[idx] = s
                break
            low = s <= 0
            step = (x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300)).min()
            x[idx] += step * (s - x[idx])
            active[idx[x[idx] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """[(combination, repeats)] that uses up the histogram {grid length: pieces} exactly."""
    left = {k: v for k, v in histogram.items() if v}
    out: list[tuple[dict[int, int], int]] = []
    combos = [c for c in combinations(bins, depth) if all(k in left for k in c)]
    if combos:
        rows = {k: i for i, k in enumerate(sorted(left))}
        a = np.zeros((len(rows), len(combos)))
        for j, c in enumerate(combos):
            for k, m in c.items():
                a[rows[k], j] = m
        b = np.array([left[k] for k in sorted(left)], float)
        weight = np.sqrt(np.array(sorted(left), float) / bins)[:, None]  # a long piece left over costs more
        x = nnls(a * weight, b * weight[:, 0] / b.max()) * b.max()
        for j in np.argsort(-x, kind="stable"):
            n = min([int(x[j] + 1e-6), *(left[k] // m for k, m in combos[j].items())])
            if n > 0:
                out.append((combos[j], n))
                for k, m in combos[j].items():
                    left[k] -= n * m
    while left := {k: v for k, v in left.items() if v}:  # greedy: the longest, then what fits beside it
        combo: dict[int, int] = {}
        room = bins
        for k in sorted(left, reverse=True):
            if m := min(left[k], room // k):
                combo[k] = m
                room -= m * k
        n = min(left[k] // m for k, m in combo.items())
        out.append((combo, n))
        for k, m in combo.items():
            left[k] -= n * m
    return out


def pack(parts: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length (1 to ``window``). ``parts``
    should be a written table: it is read three times."""
    bins = window // grain
    parts = parts.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["bin"]: r["count"] for r in parts.groupBy("bin").count().collect()}  # bins rows at most
    salts = sum(histogram.values()) // RANKED + 1

    first: dict[int, list[tuple[int, int, int, int]]] = {}  # bin: (first rank, repeats, first sequence, first slot)
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for combo, repeats in plan(histogram, bins, depth):
        slot = 0
        for k in sorted(combo, reverse=True):
            first.setdefault(k, []).append((used[k], repeats, sequence, slot))
            used[k] += combo[k] * repeats
            slot += combo[k]
        sequence += repeats
    table = {k: np.array(v, np.int64).T for k, v in first.items()}

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("bin", "salt").count().select("bin", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(bases, ["bin", "salt"]).withColumn("rank", F.col("base") + F.col("k") - 1).drop("k", "base", "salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("bin")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            seq, slot = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
            for k in np.unique(of):
                at = np.flatnonzero(of == k)
                lo, repeats, start, slots = table[int(k)][:, np.searchsorted(table[int(k)][0], rank[at], "right") - 1]
                seq[at] = start + (rank[at] - lo) % repeats
                slot[at] = slots + (rank[at] - lo) // repeats
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("bin", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(seq), pa.array(slot)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "slot"])

    kept = [f for f in ranked.schema.fields if f.name not in ("bin", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, slot long"
    placed = ranked.mapInArrow(place, schema)
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).drop("slot")


def pack_documents(docs: DataFrame, vocab: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, end_id: int = END_ID, together: int = TOGETHER, cached: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``together`` and ``cached`` as in ``pieces``."""
    return pack(materialize(pieces(docs, vocab, window, end_id, together=together, cached=cached), "pieces"), window, grain, depth)
