"""Token-id files of patched frame-of-reference blocks.

A file holds consecutive documents' ids, cut into blocks of 1024. A block stores its minimum, and
each id less that minimum in as many bits as ``share`` of its ids need; the bits above that width of
the others go to an exception list of (place, high part). The header has the documents' ids and
lengths and the start of every block in the file, so a reader can seek.

Documents are range-partitioned by doc_id; each task writes its documents, in ascending order, to
files of at most ``file_ids`` ids (or one document) in the shared folder. A file's name is unique to
the attempt that wrote it, and only the files in the written manifest count, so a task that is lost
or runs twice leaves nothing wrong. The manifest also gives each file the number of ids before it.

Defined results: null or empty text is the end id alone; rows with equal doc_id stand next to each
other, ordered by text; null ids come first; an empty table gives no files and no rows.

Layout, little-endian: magic; documents, blocks (uint32); per document a null flag (uint8), id
(int64) and length (int64); per block its byte offset (int64); then per block minimum (uint32),
width (uint8), exceptions (uint16), ids (uint16), packed ids (uint64 words), exception places
(uint16) and high parts (uint32).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.tokens import encoder, gathered
from almanac.llm.util import bounded_batches, columns, materialize, shared_path

MAGIC = b"PFOR0001"
BLOCK, SHARE, END_ID, FILE_IDS = 1024, 0.9, 2, 4_000_000
#: Bits of the numbers below 2**16.
BITS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)
COUNTS, BLOCK_HEAD = Struct("<II"), Struct("<IBHH")


def pack_bits(v: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width -> (blocks, BLOCK * width / 64) words."""
    out = np.zeros((BLOCK * width // 64, len(v)), np.uint64)
    columns_ = np.ascontiguousarray(v.T)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns_[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns_[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint64)
    columns_ = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        x = columns_[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | columns_[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T)


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, share: float = SHARE) -> bytes:
    """The file of documents with these ids (uint32), one after the other."""
    n_blocks = -(-len(ids) // BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    if n_blocks:
        sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    v = np.zeros(n_blocks * BLOCK, np.uint64)
    v[: len(ids)] = ids
    v[len(ids) :] = ids[-1] if len(ids) else 0
    v = v.reshape(n_blocks, BLOCK)
    low = v.min(1) if n_blocks else np.zeros(0, np.uint64)
    v = v - low[:, None]
    small = int(v.max(initial=0)) < len(BITS)
    bits = BITS[v] if small else np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.uint8)
    widths = np.sort(bits, 1)[:, max(0, int(np.ceil(share * BLOCK)) - 1)] if n_blocks else np.zeros(0, np.int64)
    over = bits > widths[:, None]
    block, place = np.nonzero(over)
    high = (v[block, place] >> widths[block].astype(np.uint64)).astype("<u4").tobytes()
    place = place.astype("<u2").tobytes()
    first = np.cumsum([0, *np.bincount(block, minlength=n_blocks)]).tolist()
    bodies: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        packed = pack_bits(v[at] & np.uint64((1 << int(width)) - 1), int(width))
        for k, words in zip(at, packed, strict=True):
            a, b = first[k], first[k + 1]
            bodies[k] = BLOCK_HEAD.pack(int(low[k]), int(width), b - a, int(sizes[k])) + words.astype("<u8").tobytes() + place[2 * a : 2 * b] + high[4 * a : 4 * b]
    head = len(MAGIC) + COUNTS.size + len(lengths) * 17 + n_blocks * 8
    starts = head + np.cumsum([0, *map(len, bodies)])[:n_blocks]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, COUNTS.pack(len(lengths), n_blocks), nulls.tobytes(), keys.tobytes(), np.array(lengths, "<i8").tobytes(), starts.astype("<i8").tobytes(), *bodies])


def load(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_blocks = COUNTS.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + COUNTS.size
    nulls = np.frombuffer(data, np.uint8, n_docs, at)
    keys = np.frombuffer(data, "<i8", n_docs, at + n_docs)
    lengths = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
    starts = np.frombuffer(data, "<i8", n_blocks, at + 17 * n_docs).tolist()
    heads = [BLOCK_HEAD.unpack_from(data, s) for s in starts]
    values = np.zeros((n_blocks, BLOCK), np.uint64)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        n = BLOCK * int(width) // 64
        words = np.frombuffer(b"".join(data[starts[k] + BLOCK_HEAD.size : starts[k] + BLOCK_HEAD.size + 8 * n] for k in own), "<u8").reshape(len(own), n)
        values[own] = unpack_bits(words, int(width))
    for k, (low, width, n_over, _) in enumerate(heads):
        if n_over:
            p = starts[k] + BLOCK_HEAD.size + BLOCK * width // 8
            places = np.frombuffer(data, "<u2", n_over, p)
            values[k, places] |= np.frombuffer(data, "<u4", n_over, p + 2 * n_over).astype(np.uint64) << np.uint64(width)
        values[k] += np.uint64(low)
    total = int(lengths.sum())
    return [None if z else k for z, k in zip(nulls.tolist(), keys.tolist(), strict=True)], lengths, values.reshape(-1)[:total].astype("<u4")


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file to a local or shared path or to any store that Arrow's file systems reach."""
    if folder.startswith("file:") or "://" not in folder:
        path = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def write(docs: DataFrame, folder: str, vocab: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents' ids under ``folder``; the manifest: file, part, roll, n_docs, n_ids and
    first (ids in all files before). It is a written table."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, roll = encoder(vocab), TaskContext.get().partitionId(), 0
        attempt = uuid.uuid4().hex[:12]
        keys: list[int | None] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{roll:06d}-{attempt}.pfor"
            put(folder, name, dump(keys, [len(x) // 4 for x in raw], np.frombuffer(b"".join(raw), "<u4")))
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "roll": roll, "n_docs": len(keys), "n_ids": size // 4}], schema)

        for ids, texts in gathered(batches):
            for doc_id, x in zip(ids, enc.encode(texts), strict=True):
                if keys and size + len(x) + 4 > 4 * file_ids:
                    yield flush()
                    keys, raw, size, roll = [], [], 0, roll + 1
                keys.append(doc_id)
                raw.append(x + end)
                size += len(x) + 4
        if keys:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = materialize(ordered.mapInArrow(run, "file string, part int, roll int, n_docs long, n_ids long"), "manifest")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each task of the write
    parts = parts.select("part", ahead(Window.orderBy("part")).alias("before"))
    within = files.withColumn("inside", ahead(Window.partitionBy("part").orderBy("roll")))
    return within.join(parts, "part").withColumn("first", F.col("before") + F.col("inside")).drop("before", "inside")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*columns(batch, "path", "content"), strict=True):
                keys, lengths, ids = load(data)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array([path.rsplit("/", 1)[-1]] * len(keys)), pa.array(keys, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    schema = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    rows = files.mapInArrow(run, schema).join(manifest.select("file", "first"), "file")
    return rows.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocab: str, folder: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    manifest = write(docs, folder, vocab, end_id, file_ids)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
