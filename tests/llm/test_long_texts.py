"""Long texts, notices and profiles against plain versions, and columns with odd names."""

import random
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from almanac.llm import exact_dedup, hyperdim, jaccard_join, license_scan, recompression, repetition


def whole_text_spans(notices, text):
    """Each pattern over the whole text, best match first, then what lies before and after it."""
    out = []
    for (notice, label, k), pattern in zip(notices.notices, notices.patterns, strict=True):
        parts = [(0, len(text))]
        while parts:
            lo, hi = parts.pop()
            if hi - lo >= len(notice) - k and (m := pattern.search(text, lo, hi)):
                a, b = m.span()
                out.append(license_scan.Span(label, text[: a + (text[a] == " ")].count(" "), text[: b - (text[b - 1] == " ")].count(" ") + 1, sum(m.fuzzy_counts)))
                parts += [(lo, a), (b, hi)]
    within = lambda x, s: x.label == s.label and s.first <= x.first and x.last <= s.last
    return {s for s in out if not any(x.first < s.last and s.first < x.last and x.edits < s.edits and not within(x, s) for x in out)}


def misspelt(rnd, text, edits):
    for _ in range(edits):
        at = rnd.randrange(len(text))
        text = text[:at] + rnd.choice(["", "x", text[at] + "y"]) + text[at + 1 :]
    return text


@pytest.mark.parametrize("seed", range(12))
def test_notices_are_those_of_the_whole_text(seed):
    rnd = random.Random(seed)
    notices = license_scan.Notices(license_scan.NOTICES)
    parts = []
    for _ in range(25):
        parts += rnd.choices("the license general public under version free code of software".split(), k=rnd.randint(0, 12))
        text, _, k = rnd.choice(notices.notices)
        parts.append(misspelt(rnd, text, rnd.randint(0, k)))
    text = " ".join(" ".join(parts).split())
    assert set(notices.spans(text)) == whole_text_spans(notices, text)


@pytest.mark.parametrize("notice", ["mit licence ", "mit license ", "gnu lesser general public licence "])
def test_notices_take_linear_time(notice, monkeypatch):
    looked, real = [], license_scan.Notices.best
    monkeypatch.setattr(license_scan.Notices, "best", lambda self, i, part, at: looked.append(len(part)) or real(self, i, part, at))
    work = []
    for n in (2000, 8000):
        looked.clear()
        found = license_scan.scan_text(notice * n, license_scan.PHRASES, license_scan.Notices(license_scan.NOTICES))
        assert len(found["spans"]) == n
        work.append(sum(looked))
        assert max(looked) < 120
    assert work[1] <= 4.1 * work[0]


def plain_vector(text, dim=hyperdim.DIM, n=hyperdim.N):
    """The text's vector from the definition, one n-gram at a time."""
    read, out = [], np.zeros(dim)
    for c in f" {text} ":
        letter = unicodedata.category(c)[0] == "L"
        c = (c.lower() if len(c.lower()) == 1 else c) if letter else " "
        if letter or read[-1:] != [" "]:
            read.append(c)
    for gram in zip(*(read[k:] for k in range(n)), strict=False):
        if gram[n // 2] == " ":
            continue
        v = np.ones(dim)
        for place, c in enumerate(gram):
            v = v * np.roll(hyperdim.letter_vector(0 if c == " " else ord(c), dim), n - 1 - place)
        out += v
    return out


def test_profiles_from_the_definition(spark):
    rnd = random.Random(2)
    words = {"aa": "ka lo Mi shu".split(), "bb": "über größe äpfel".split(), "cc": "漢字 仮名 文章".split()}
    rows = [(i, " ".join(rnd.choice([*words[x], "ab1c", "-- 7"]) for _ in range(rnd.randint(1, 25))), x) for i in range(60) for x in [rnd.choice("aa bb cc".split())]]
    rows += [(60, "", "aa"), (61, "7 7", "bb"), (62, None, "aa"), (63, "ka", None)]
    learned = {}
    for i, t, x in rows:
        if t is not None and x is not None and zlib.crc32(str(i).encode()) % 5:
            learned[x] = learned.get(x, 0) + plain_vector(t)
    names = sorted(learned)
    got = {r.doc_id: r for r in hyperdim.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        v = plain_vector(t or "")
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosine = [v @ learned[x] / np.linalg.norm(v) / np.linalg.norm(learned[x]) for x in names]
        best = int(np.argmax(cosine))
        assert got[i].lang_pred == names[best] and abs(got[i].score - min(1, max(0, cosine[best]))) < 1e-5


def test_equal_cosines_go_to_the_first_label(spark):
    v = hyperdim.bundle(["ka lo"], hyperdim.Grams(hyperdim.DIM, hyperdim.N))[0].astype(float)
    docs = spark.createDataFrame([(1, "ka lo mi")], "doc_id long, text string")
    assert hyperdim.classify(docs, {"zz": v, "bb": v, "mm": v}).first().lang_pred == "bb"


def test_profile_of_a_long_text_is_bounded():
    rnd = random.Random(1)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(100_000))
    hyperdim.letter_table()
    tracemalloc.start()
    v = hyperdim.bundle([text], hyperdim.Grams(hyperdim.DIM, hyperdim.N))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and v.shape == (1, hyperdim.DIM)


def test_columns_of_any_name(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    own = [" ".join(rnd.choice(words) for _ in range(90)) for _ in range(6)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [*own, own[0] + " end", own[1], f"{own[2]} {passage}", f"{own[3]} {own[4]} {passage}", "short", None]
    rows = [(d, t, 0.5, "x", [d], d) for d, t in enumerate([*texts, own[5].upper()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double, `c``d` string, `e f` array<int>, `g.h.i` long")
    clashing = docs.unionByName(docs.where("doc_id = 5").selectExpr("doc_id", "concat(text, ' ', text, ' and more of it') AS text", "`a.b`", "`c``d`", "`e f`", "`g.h.i`"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert all(r["g.h.i"] == r.doc_id and r["e f"] == [r.doc_id] for r in got.collect()), name
        assert stage(spark, clashing, "").count() > 0
    kept = {r.doc_id for r in repetition.keep_good(docs).collect()}
    assert kept == set(range(13)) - {10, 11}
    assert Counter(r.doc_id for r in exact_dedup.drop_copies(docs, one_row=True).collect()) == Counter(set(range(13)) - {1, 5})
    assert {0, 6} & {r.doc_id for r in jaccard_join.one_of_each(docs, 5, 80).collect()} == {0}
    last = {r.doc_id: r.text for r in recompression.without_repeats(docs).collect()}
    assert passage in last[8] and passage not in last[9]
