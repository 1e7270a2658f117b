"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

from almanac.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key string, `a.b` int"


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:k] + b[k : k + len(b) - len(a)] + a[k:] == b if len(a) < len(b) else a[:k] + b[k] + a[k + 1 :] == b for k in range(len(b)))


def naive(docs, least=7, count=2, times=10):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= count}
    near = {w: [v for v in n if edits_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def changed(rnd, w, letters):
    at = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:at] + rnd.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at + 1 :]])


def some_docs(seed):
    rnd = random.Random(seed)
    letters = "abcéÉß"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 13))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "A" * 40]
    pool = []
    for s in stems:
        one = changed(rnd, s, letters)
        two = changed(rnd, one, letters)
        pool += [s] * 300 + [one] * 30 + [two] * 3 + [changed(rnd, s, letters) for _ in range(6)] * 2
    docs = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 400)))) for k in range(90)]
    return [*docs, docs[5], docs[5], (None, "abababab Abababab x1abababab_ababababc " * 8), (7, None), (8, ""), (9, "é" * 9000 + " " + "é" * 9001), (10, ("é" * 9000 + ",") * 25)]


def test_variants(spark):
    docs = some_docs(4)
    df = spark.createDataFrame([(i, t, "w", 1, "k", 2) for i, t in docs], SCHEMA).repartition(4)
    out = spelling.variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = out.collect()
    want = naive(docs)
    assert {r["word"]: tuple(r)[1:] for r in got} == {w: v for w, v in want.items()}
    assert len(got) == len(want) > 100
    assert any(r["form"] and r["root"] != r["form"] for r in got) and any(r["n_near"] and not r["form"] for r in got)


def test_every_edit_is_found(spark):
    word = "abcdefghijkl"
    for base in (word, word[:7], word[:8], word[:9]):
        words = {base} | {base[:k] + "X" + base[k:] for k in range(len(base) + 1)} | {base[:k] + "X" + base[k + 1 :] for k in range(len(base))} | {base[:k] + base[k + 1 :] for k in range(len(base))}
        words = sorted(w for w in words if len(w) >= 7)
        pairs = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
        assert sorted((r["a"], r["b"]) for r in pairs) == [(a, b) for a in words for b in words if a < b and edits_one(a, b)]


def test_ties_and_nothing(spark):
    docs = [(None, "anagrams " * 2 + "anagramx " * 20 + "anagramb " * 20)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got["anagrams"]["form"] == "anagramb" and got["anagramb"]["form"] is None and got["anagrams"]["n_near"] == 2
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")).count() == 0


def test_letters_shared_by_many_words_make_few_candidates(spark):
    """4000 words with one first half: pairs joined stay near the number of words."""
    rnd = random.Random(1)
    words = sorted({"common" + "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(4000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    word, size = spelling.F.col("word"), spelling.F.length("word")
    left = df.select(spelling.F.explode(spelling.F.array(*(spelling.without_quarter(word, size, q, 0) for q in range(4)))).alias("key"))
    right = df.select(spelling.F.explode(spelling.F.array(*(spelling.without_quarter(word, size - s, q, s) for q in range(4) for s in (-1, 0, 1)))).alias("key"))
    assert left.join(right, "key").count() < 30 * len(words)
