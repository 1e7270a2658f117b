"""Scoring of texts by a hashed maximum-entropy language model.

The probability of a token is that of its class times its own within the class, both softmaxes. The
most frequent words make up ``FREQUENT`` classes of ``MEMBERS`` words each, by falling count; all other words,
unseen ones too, fall into ``RARE`` classes by their last two bytes. A class's logit is the log of its
share of the corpus plus a weight for each feature of the context: the word before (bigram), the two before
(trigram), the word before last and the one before that (skips). A frequent word's logit within its class
is made likewise of its count and the features' weights for that class. Features are hashed into
rows of a table with one weight a class (or member); a context word beyond the frequent ones counts
as its class. Within a rare class words have their smoothed share of the class's training tokens.

Training is one pass over all training documents in ``STEPS`` slices. For a slice every task sums how often
features and classes (members) occur together and how often the model so far expects them to; their
difference is the gradient, and a weight moves by a part of the logarithm of their ratio. The sums are
added up on Spark; the driver holds only weights, whose size is fixed.

Counts of words are a table on Spark that grows with the corpus. The ``COUNTED`` most frequent words, a bounded
table, are broadcast; all others of a document are joined with it, by word.

Defined results: a null text is empty and has one token, the end; a row with a null doc_id is scored
with held_out false, but nothing is learned from it; repeated rows count and are scored each; without any training
document all counts are 0; an empty table gives no rows. Texts are read whole whatever their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.sums import SCHEMA, pieces, summed
from almanac.llm.util import bounded_batches, materialize

#: The text's end as a token; words hold no white space.
END = b"\n"
MEMBERS, FREQUENT, RARE = 64, 48, 16
CLASSES = FREQUENT + RARE
WORDS = FREQUENT * MEMBERS
BEFORE = WORDS + RARE  # id of the places before a text
COUNTED = 1 << 18
#: Rows of the two weight tables, a power of two of at most 2^16.
ROWS = 1 << 14
STEPS, RATE, PRIOR = 5, 0.35, 3.0
#: Training tokens of a task; tokens that go through numpy together; words counted by a task before it hands them on.
TASK_TOKENS, BLOCK, HELD = 4_000_000, 2048, 400_000
#: Rows of a block met more often than this are summed by themselves.
OFTEN = 16
#: Blocks whose shares are added up together.
TOGETHER = 8
SMOOTH = 0.1
#: Odd factors of the features' hashes, and which of the words before (1 is the last) make each feature.
FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
FEATURES = [(1,), (2,), (3,), (1, 2)]
#: The features used within classes.
INNER = 2


def ending(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % RARE


def tokens_of(text: str | None) -> list[bytes]:
    """Words between white space with A-Z in lower case, then the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


# --- counts -----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10 == 0


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c, class) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "c"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens_of(text))
                if len(found) > HELD:
                    yield counted()
                    found = Counter()
        yield counted()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token binary, c long")
    return words.groupBy("token").agg(F.sum("c").alias("c")).withColumn("class", (F.crc32(F.expr("substring(token, -2, 2)")) % RARE).cast("int"))


@dataclass
class Counts:
    """What the tasks must know of the corpus; ``tokens`` are the most frequent ones in falling order."""

    n: int
    v: int
    tokens: list[bytes]
    c: np.ndarray
    rare_n: np.ndarray
    rare_v: np.ndarray
    #: The tokens' ids: a place in a frequent class, or a rare class.
    ids: np.ndarray | None = None

    def __post_init__(self):
        if self.ids is None:
            own = np.arange(len(self.tokens))
            own[WORDS:] = [WORDS + ending(t) for t in self.tokens[WORDS:]]
            self.ids = own.astype(np.uint16)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))

    def in_class(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class."""
        return np.log10((c + SMOOTH) / (self.rare_n[k] + SMOOTH * (self.rare_v[k] + 1)))


def level(c: str) -> Column:
    return F.floor(F.log2(c) * 16)


def corpus_counts(vocabulary: DataFrame, counted: int = COUNTED) -> tuple[Counts, DataFrame]:
    """Counts, and the rest of ``vocabulary`` (token, c). The frequent tokens are those above the least level
    of counts (sixteen to a power of two, so at most 1024) that no more than ``counted`` tokens reach."""
    sums = vocabulary.groupBy(level("c").alias("level"), "class").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    by_level: Counter[int] = Counter()
    for r in sums:
        by_level[r["level"]] += r["v"]
    least, reached = 1 << 20, 0
    for at in sorted(by_level, reverse=True):
        reached += by_level[at]
        if reached > counted:
            break
        least = at
    top = vocabulary.where(level("c") >= least).select("token", "c").toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    tokens, c = top["token"].to_pylist(), top["c"].to_numpy()
    rare_n, rare_v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in sums:
        rare_n[r["class"]] += r["n"]
        rare_v[r["class"]] += r["v"]
    for token, n in zip(tokens[:WORDS], c[:WORDS].tolist(), strict=True):
        rare_n[ending(token)] -= n
        rare_v[ending(token)] -= 1
    counts = Counts(sum(r["n"] for r in sums), sum(r["v"] for r in sums), tokens, c, rare_n, rare_v)
    return counts, vocabulary.where(level("c") < least).select("token", "c")


class Ranks(dict):
    """Token to rank, -1 for the others."""

    def __missing__(self, token: bytes) -> int:
        return -1


ENCODED = "row long, doc_id long, held_out boolean, slice int, n_tokens long, n_known long, base double, rare double, ids binary, tail array<struct<token:binary,k:int>>"


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """ENCODED: each document's ids, its sums over the counted tokens, and its other tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counts = shared.value
        ranks = Ranks(zip(own.tokens, range(len(own.tokens)), strict=True))
        ids = np.append(own.ids, np.uint16(BEFORE))
        base = np.append(own.base(own.c), 0.0)
        rare = np.zeros(len(ids))
        if len(own.tokens) > WORDS:
            rare[WORDS:-1] = own.in_class(own.c[WORDS:], own.ids[WORDS:].astype(np.int64) - WORDS)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            words = [tokens_of(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            if not words:
                continue
            ends = np.cumsum([0, *map(len, words)])
            flat = [w for own_words in words for w in own_words]
            rank = np.fromiter(map(ranks.__getitem__, flat), np.int64, len(flat))
            at, known = ids[rank], rank >= 0
            tails: list[Counter[bytes]] = [Counter() for _ in words]
            others = np.flatnonzero(~known)
            for k, doc in zip(others.tolist(), (np.searchsorted(ends, others, side="right") - 1).tolist(), strict=True):
                word = flat[k]
                tails[doc][word] += 1
                at[k] = WORDS + ending(word)
            entries = pa.StructArray.from_arrays([pa.array([w for t in tails for w in t], pa.binary()), pa.array([k for t in tails for k in t.values()], pa.int32())], names=["token", "k"])
            sums = lambda x: np.add.reduceat(x, ends[:-1])
            kept = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "held_out", "slice")}
            made = {
                "row": np.arange(row, row + len(words)), "n_tokens": np.diff(ends), "n_known": sums(known.astype(np.int64)), "base": sums(base[rank]), "rare": sums(rare[rank]),
                "ids": pa.array([at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "tail": pa.ListArray.from_arrays(np.cumsum([0, *map(len, tails)], dtype=np.int32), entries),
            }
            row += len(words)
            yield pa.RecordBatch.from_pydict(made | kept).select(NAMES)

    return docs.mapInArrow(run, ENCODED)


NAMES = ["row", "doc_id", "held_out", "slice", "n_tokens", "n_known", "base", "rare", "ids", "tail"]


# --- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_table: np.ndarray
    word_table: np.ndarray

    @classmethod
    def untrained(cls, counts: Counts) -> Model:
        """Without weights: shares of the corpus. Absent classes and members have none."""
        c = np.zeros(WORDS)
        c[: min(WORDS, len(counts.c))] = counts.c[:WORDS]
        c = c.reshape(FREQUENT, MEMBERS)
        mass = np.concatenate([c.sum(axis=1), counts.rare_n + SMOOTH * (counts.rare_v + 1)])
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4).astype(np.float32)
        return cls(log(mass / mass.sum()), log(c / np.maximum(c.sum(axis=1, keepdims=True), 1e-300)), np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32))


@dataclass
class Places:
    """Tokens of some texts with the words before them: target ids and rows of the weight tables."""

    text: np.ndarray
    target: np.ndarray
    kind: np.ndarray
    rows: list[np.ndarray]
    before: list[np.ndarray]

    def inner_rows(self, at: np.ndarray) -> list[np.ndarray]:
        kind = self.kind[at].astype(np.uint64)
        return [hashed(self.before[f][at] * np.uint64(CLASSES) + kind + np.uint64(1 << 40), FACTORS[f]) for f in range(INNER)]


def hashed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = x * factor
    return ((x ^ (x >> np.uint64(29))) * FACTORS[0] >> np.uint64(40)).astype(np.uint16) & np.uint16(ROWS - 1)


def places(texts: list[np.ndarray]) -> Iterator[Places]:
    """Blocks of BLOCK tokens."""
    far = max(max(f) for f in FEATURES)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.full(int((sizes + far).sum()), BEFORE, np.uint64)
    starts = np.cumsum(sizes + far) - sizes
    for s, t in zip(starts.tolist(), texts, strict=True):
        flat[s : s + len(t)] = t
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    for k in range(0, len(at), BLOCK):
        here = at[k : k + BLOCK]
        before = [sum((flat[here - d] * np.uint64(1 << 16 * i) for i, d in enumerate(f)), np.uint64(0)) for f in FEATURES]
        target = flat[here].astype(np.int64)
        kind = np.where(target < WORDS, target // MEMBERS, target - WORDS + FREQUENT)
        yield Places(text[k : k + BLOCK], target, kind, [hashed(b, f) for b, f in zip(before, FACTORS, strict=True)], before)


def softmax(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the natural logs of the shares of ``column``, exponentials, their sums)."""

    def logits() -> np.ndarray:
        x = np.take(table, rows[0], axis=0)
        for r in rows[1:]:
            x += np.take(table, r, axis=0)
        x += bias
        return x

    def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = x[np.arange(len(x)), column].astype(np.float64)
        e = np.exp(x, out=x)
        total = e @ np.ones(e.shape[1], e.dtype)
        return chosen, e, total

    x = logits()
    plain = x.max() < 80
    if plain:
        chosen, e, total = shares(x)
        plain = total.min() > 1e-30
    if not plain:  # far logits: less each row's maximum
        x = logits()
        x -= x.max(axis=1, keepdims=True)
        chosen, e, total = shares(x)
    return chosen - np.log(total.astype(np.float64)), e, total


def log_probabilities(model: Model, p: Places) -> np.ndarray:
    """log10 of each token's class and, for a frequent word, of its place in the class."""
    out, _, _ = softmax(model.class_bias, model.class_table, p.rows, p.kind)
    at = np.flatnonzero(p.target < WORDS)
    if len(at):
        out[at] += softmax(model.word_bias[p.kind[at]], model.word_table, p.inner_rows(at), p.target[at] % MEMBERS)[0]
    return out / np.log(10)


def add_rows(table: np.ndarray, rows: list[np.ndarray], values: np.ndarray) -> None:
    """table[r] += values for each of ``rows``. Equal rows are brought together: those met often are
    summed in one product each, the others place by place."""
    key = np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    key, own = key[order], np.take(values, order % len(values), axis=0)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(start, len(key)))
    ones = np.ones(int(sizes.max()), values.dtype)
    for k in np.flatnonzero(sizes > OFTEN).tolist():
        table[key[start[k]]] += ones[: sizes[k]] @ own[start[k] : start[k] + sizes[k]]
    start, sizes = start[sizes <= OFTEN], sizes[sizes <= OFTEN]
    out = np.take(own, start, axis=0)
    for place in range(1, OFTEN):
        at = np.flatnonzero(sizes > place)
        out[at] += np.take(own, start[at] + place, axis=0)
    table[key[start]] += out


class Gradient:
    """Observed and expected sums of both tables. Shares are added up some blocks at a time, observed
    cells more, as rows met again are then summed before they reach the table."""

    def __init__(self):
        self.sums = np.zeros((2, 2, ROWS, CLASSES), np.float32)
        self.shares: list[list[tuple[list[np.ndarray], np.ndarray]]] = [[], []]
        self.cells: list[list[np.ndarray]] = [[], []]
        self.blocks = self.waiting = 0

    def add(self, model: Model, p: Places) -> None:
        self.observe(0, p.rows, p.kind, softmax(model.class_bias, model.class_table, p.rows, p.kind))
        at = np.flatnonzero(p.target < WORDS)
        if len(at):
            rows, column = p.inner_rows(at), p.target[at] % MEMBERS
            self.observe(1, rows, column, softmax(model.word_bias[p.kind[at]], model.word_table, rows, column))
        self.blocks += 1
        if self.blocks == TOGETHER:
            self.expect()
        if self.waiting > ROWS * CLASSES:
            self.count()

    def observe(self, table: int, rows: list[np.ndarray], column: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        _, e, total = found
        e *= (1 / total)[:, None]
        self.shares[table].append((rows, e))
        self.cells[table] += [r.astype(np.int64) * CLASSES + column for r in rows]
        self.waiting += len(rows) * len(column)

    def expect(self) -> None:
        for table, own in enumerate(self.shares):
            if own:
                add_rows(self.sums[table, 1], [np.concatenate(r) for r in zip(*(rows for rows, _ in own), strict=True)], np.concatenate([e for _, e in own]))
        self.shares, self.blocks = [[], []], 0

    def count(self) -> np.ndarray:
        """The sums, with all that waits counted."""
        self.expect()
        for table, own in enumerate(self.cells):
            if own:
                self.sums[table, 0] += np.bincount(np.concatenate(own), minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
        self.cells, self.waiting = [[], []], 0
        return self.sums


def stepped(model: Model, sums: np.ndarray, rate: float = RATE, prior: float = PRIOR) -> Model:
    """The model after one step. ``prior`` pseudo-counts hold back cells seen or expected seldom."""

    def moved(table: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        move = np.log(seen + prior)
        move -= np.log(expected + prior)
        move *= rate
        return table + move.astype(np.float32)

    return Model(model.class_bias, model.word_bias, moved(model.class_table, *sums[0]), moved(model.word_table, *sums[1]))


def train(encoded: DataFrame, counts: Counts, steps: int = STEPS) -> Model:
    """One step for each slice of the documents that are learned from."""
    model = Model.untrained(counts)
    spark = encoded.sparkSession
    tasks = max(1, -(-counts.n // (steps * TASK_TOKENS)))
    for step in range(steps if counts.n else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Gradient()
            for batch in batches:
                for p in places([np.frombuffer(b, np.uint16) for b in batch.column(0).to_pylist()]):
                    found.add(shared.value, p)
            yield pieces(found.count())

        own = encoded.where(F.col("slice") == step).select("ids").coalesce(tasks)
        model = stepped(model, summed(own.mapInArrow(run, SCHEMA), (2, 2, ROWS, CLASSES), np.float32))
        shared.destroy()  # else the driver holds the weights of every step
    return model


def apply(encoded: DataFrame, model: Model) -> DataFrame:
    """(row, model): the sum of each document's log_probabilities."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for p in places([np.frombuffer(b, np.uint16) for b in batch.column(batch.schema.get_field_index("ids")).to_pylist()]):
                total += np.bincount(p.text, log_probabilities(shared.value, p), batch.num_rows)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in SCORED]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], names=[*SCORED, "model"])

    return encoded.select(*SCORED, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, model double")


SCORED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare"]


def tail_sums(encoded: DataFrame, rest: DataFrame, counts: Counts) -> DataFrame:
    """(row, known, base, rare) over the tokens of each document that aren't among the counted ones."""
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.k")
    found = tail.join(rest, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    class_size = F.element_at(F.array(*(F.lit(float(n + SMOOTH * (v + 1))) for n, v in zip(counts.rare_n.tolist(), counts.rare_v.tolist(), strict=True))), (F.crc32(F.expr("substring(token, -2, 2)")) % RARE + 1).cast("int"))
    k, c = F.col("k"), F.col("c") + SMOOTH
    return found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("tail_known"),
        F.sum(k * F.log10(c / (counts.n + SMOOTH * (counts.v + 1)))).alias("tail_base"),
        F.sum(k * F.log10(c / class_size)).alias("tail_rare"),
    )


def fit(docs: DataFrame, steps: int = STEPS, counted: int = COUNTED) -> tuple[Model, Counts, DataFrame, DataFrame]:
    """The trained model, the corpus counts, ``docs`` encoded, and the words beyond the counted ones."""
    bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.when(~held_out(doc_id), F.floor(F.crc32(doc_id.cast("string")) / 10) % steps).cast("int").alias("slice"))
    vocabulary = materialize(count_tokens(docs.where("slice is not null")), "vocabulary")
    counts, rest = corpus_counts(vocabulary, counted)
    encoded = materialize(encode(docs, counts), "encoded")
    return train(encoded, counts, steps), counts, encoded, rest


def score(docs: DataFrame, steps: int = STEPS, counted: int = COUNTED) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts, encoded, rest = fit(docs, steps, counted)
    out = apply(encoded, model).join(tail_sums(encoded, rest, counts), "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("model") + F.col("rare") + zero("tail_rare")).alias("score"),
    )
