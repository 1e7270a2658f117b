"""The maximum-entropy scorer against plain Python: counts and base from the definition, the model's
probabilities token by token, one training step from its formula."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from almanac.llm import maxent

SCHEMA = "doc_id long, text string, held_out string, n long, ids string, `a.b` int"


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall("[^\x20\x09-\x0d]+", t), None]


def rest_of(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def some_docs(seed, n=120):
    rnd = random.Random(seed)
    docs = []
    for k in range(n):
        lang = k % 3
        vocab = [f"{'abc'[lang]}{chr(233) * (j % 2)}{j}" for j in range(60)] + ["The", "the", "x"]
        words = [vocab[min(int(rnd.expovariate(0.1)), 62)] for _ in range(rnd.randint(0, 150))] + [f"rare{rnd.randrange(400)}"]
        docs.append((k, rnd.choice([" ", "\n", "\t "]).join(words)))
    return [*docs, docs[3], (3, "another text"), (None, "no id here"), (200, None), (201, ""), (202, " \n"), (203, "longword" * 3000 + " a1" * 9000)]


def naive_base(docs):
    train = [t for i, text in docs if i is not None and rest_of(i, 10) for t in tokens(text)]
    c, n = Counter(train), len(train)
    out = []
    for i, text in docs:
        own = tokens(text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (len(c) + 1))) for t in own)
        out.append((i, i is not None and rest_of(i, 10) == 0, len(own), sum(c[t] > 0 for t in own), n, base))
    return c, n, out


def hash_(x, f):
    m = (1 << 64) - 1
    x = x * int(maxent.FACTORS[f]) & m
    return (((x ^ (x >> 29)) * int(maxent.FACTORS[0]) & m) >> 40) % (1 << 16) % maxent.ROWS


class Naive:
    """Probabilities token by token in plain Python."""

    def __init__(self, c, model):
        raw = lambda t: b"\n" if t is None else t.encode()
        self.rank = {t: k for k, (_, t) in enumerate(sorted((-k, raw(t)) for t, k in c.items()))}
        self.c, self.model, self.raw = {raw(t): k for t, k in c.items()}, model, raw
        self.rare = defaultdict(lambda: [0, 0])
        for t, k in self.c.items():
            if self.rank[t] >= maxent.WORDS:
                self.rare[zlib.crc32(t[-2:]) % maxent.RARE][0] += k
                self.rare[zlib.crc32(t[-2:]) % maxent.RARE][1] += 1

    def id(self, t):
        r = self.rank.get(t, maxent.WORDS)
        return r if r < maxent.WORDS else maxent.WORDS + zlib.crc32(t[-2:]) % maxent.RARE

    def shares(self, before):
        """Class probabilities and a function of a class to its members' probabilities."""
        m = self.model
        w1, w2, w3 = before
        value = [w1, w2, w3, w1 + (w2 << 16)]
        x = m.class_bias.astype(float) + sum(m.class_table[hash_(v, f)] for f, v in enumerate(value))
        e = np.exp(x - x.max())

        def members(k):
            y = m.word_bias[k].astype(float) + sum(m.word_table[hash_(value[f] * maxent.CLASSES + k + (1 << 40), f)] for f in range(maxent.INNER))
            y = np.exp(y - y.max())
            return y / y.sum()

        return e / e.sum(), members

    def score(self, text):
        before, total = (maxent.BEFORE,) * 3, 0.0
        for t in map(self.raw, tokens(text)):
            i = self.id(t)
            classes, members = self.shares(before)
            if i < maxent.WORDS:
                p = classes[i // 64] * members(i // 64)[i % 64]
            else:
                n, v = self.rare[i - maxent.WORDS]
                p = classes[i - maxent.WORDS + maxent.FREQUENT] * (self.c.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10(p)
            before = (i, *before[:2])
        return total


@pytest.fixture
def few_words(monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 2)
    monkeypatch.setattr(maxent, "CLASSES", 18)
    monkeypatch.setattr(maxent, "WORDS", 128)
    monkeypatch.setattr(maxent, "BEFORE", 144)
    monkeypatch.setattr(maxent, "ROWS", 512)


def test_base_columns(spark):
    docs = some_docs(1)
    df = spark.createDataFrame([(i, t, "h", 1, "x", 2) for i, t in docs], SCHEMA).repartition(3)
    out = maxent.score(df, counted=100)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, *[x if x is not None else -1 for x in r[:4]], round(r[5], 6))
    got = sorted((tuple(r) for r in out.collect()), key=key)
    _, _, want = naive_base(docs)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-12)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base on texts not learned from


@pytest.mark.parametrize("counted", [200, 10_000])
def test_scores_token_by_token(few_words, counted):
    docs = some_docs(2, 60)
    docs = [(i, (t or "")[:4000]) for i, t in docs]
    c, n, _ = naive_base(docs)
    rng = np.random.default_rng(3)
    own = sorted(((-k, b"\n" if t is None else t.encode()) for t, k in c.items()))
    naive = Naive(c, None)
    rare_n = np.array([naive.rare[k][0] for k in range(16)])
    rare_v = np.array([naive.rare[k][1] for k in range(16)])
    counts = maxent.Counts(n, len(c), [t for _, t in own][:counted], np.array([-k for k, _ in own])[:counted], rare_n, rare_v)
    model = maxent.Model(*(t for t in vars(maxent.Model.untrained(counts)).values()))
    model.class_bias, model.class_table = model.class_bias[:18], rng.normal(0, 0.5, (512, 18)).astype(np.float32)
    model.word_table = rng.normal(0, 0.5, (512, 64)).astype(np.float32)
    naive.model = model
    ids = [np.array([naive.id(naive.raw(t)) for t in tokens(text)], np.uint16) for _, text in docs]
    got = np.zeros(len(docs))
    for p in maxent.places(ids):
        got += np.bincount(p.text, maxent.log_probabilities(model, p), len(docs))
    for k, (_, text) in enumerate(docs):
        own = [naive.raw(t) for t in tokens(text)]
        got[k] += sum(counts.in_class(np.array(naive.c.get(t, 0)), naive.id(t) - 128) for t in own if naive.id(t) >= 128)
    assert got == pytest.approx([naive.score(t) for _, t in docs], rel=1e-5)


def test_probabilities_add_up_to_one(few_words):
    docs = some_docs(5, 60)
    c, n, _ = naive_base(docs)
    naive = Naive(c, None)
    own = sorted((-k, t) for t, k in naive.c.items())
    counts = maxent.Counts(n, len(c), [t for _, t in own], np.array([-k for k, _ in own]), np.array([naive.rare[k][0] for k in range(16)]), np.array([naive.rare[k][1] for k in range(16)]))
    rng = np.random.default_rng(1)
    model = maxent.Model.untrained(counts)
    model.class_table, model.word_table = rng.normal(0, 1, (512, 18)).astype(np.float32), rng.normal(0, 1, (512, 64)).astype(np.float32)
    naive.model = model
    classes, members = naive.shares((5, 140, maxent.BEFORE))
    assert classes.sum() == pytest.approx(1) and all(members(k).sum() == pytest.approx(1) for k in range(2))
    for k in range(16):  # the words of a rare class and one share for those unseen
        inside = [10 ** counts.in_class(np.array(v), k) for t, v in [*naive.c.items(), (b"", 0)] if not t or naive.id(t) == 128 + k]
        assert sum(inside) == pytest.approx(1)


def test_one_step_of_training():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3080, rng.integers(0, 300)).astype(np.uint16) for _ in range(30)]
    counts = maxent.Counts(10_000, 5000, [b"w%d" % k for k in range(4000)], np.arange(4000, 0, -1), np.full(16, 50), np.full(16, 20))
    model = maxent.Model.untrained(counts)
    model.class_table = rng.normal(0, 0.1, model.class_table.shape).astype(np.float32)
    found = maxent.Gradient()
    for p in maxent.places(texts):
        found.add(model, p)
    found.count()
    naive = Naive({}, model)
    sums = np.zeros(found.sums.shape)
    for t in texts:
        before = (maxent.BEFORE,) * 3
        for i in t.tolist():
            classes, members = naive.shares(before)
            w1, w2, w3 = before
            kind = i // 64 if i < maxent.WORDS else i - maxent.WORDS + maxent.FREQUENT
            for f, v in enumerate([w1, w2, w3, w1 + (w2 << 16)]):
                sums[0, 0, hash_(v, f), kind] += 1
                sums[0, 1, hash_(v, f)] += classes
                if f < maxent.INNER and i < maxent.WORDS:
                    row = hash_(v * maxent.CLASSES + kind + (1 << 40), f)
                    sums[1, 0, row, i % 64] += 1
                    sums[1, 1, row] += members(kind)
            before = (i, *before[:2])
    assert np.abs(found.sums - sums).max() < 1e-2
    moved = maxent.stepped(model, found.sums)
    assert np.abs(moved.word_table - maxent.RATE * (np.log(sums[1, 0] + maxent.PRIOR) - np.log(sums[1, 1] + maxent.PRIOR))).max() < 1e-3


def test_endings_agree_with_spark(spark):
    words = ["a", "ab", "abc", "é", "日本", "\n"]
    got = {bytes(r["token"]): r["class"] for r in maxent.count_tokens(spark.createDataFrame([(" ".join(words),)], "text string")).collect()}
    assert got == {w.encode(): maxent.ending(w.encode()) for w in words}


def test_nothing_to_learn_from(spark):
    assert maxent.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(k for k in range(100) if rest_of(k, 10) == 0)
    got = maxent.score(spark.createDataFrame([(held, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[2:6] for r in got) == [(1, 0, 0, pytest.approx(0)), (3, 0, 0, pytest.approx(0))]
    assert all(math.isfinite(r["score"]) for r in got)


def test_counted_words_are_small_on_the_driver(spark):
    n = 60_000
    vocabulary = spark.range(n).selectExpr("cast(concat('w', id) as binary) token", "id % 7 + 1 c", "cast(id % 16 as int) class")
    maxent.corpus_counts(vocabulary.limit(10))
    tracemalloc.start()
    counts, rest = maxent.corpus_counts(vocabulary)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    want = sorted((-(k % 7 + 1), b"w%d" % k) for k in range(n))
    assert counts.tokens == [t for _, t in want] and counts.c.tolist() == [-c for c, _ in want]
    assert (counts.n, counts.v, rest.count()) == (sum(counts.c.tolist()), n, 0)
    assert peak < 250 * n  # rows as Python objects took over 400 bytes a word


def test_weights_of_past_steps_leave_the_driver(spark, monkeypatch):
    made = []
    context, share = spark.sparkContext, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(context), "broadcast", lambda self, value: made.append((value, share(self, value))) or made[-1][1])
    docs = spark.createDataFrame([(k, f"a b c{k % 5}") for k in range(60)], "doc_id long, text string")
    maxent.fit(docs, steps=3)
    weights = [b for value, b in made if isinstance(value, maxent.Model)]
    assert len(weights) == 3 and not any(b._jbroadcast.isValid() for b in weights)
