"""The training-data operators against brute force, on a small table with nulls, empty and long
texts, ties, repeated rows and clashing extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from almanac.llm import byte_bpe, exact_dedup, hyperdim, jaccard_join, license_scan, links, packing, recompression, repetition, token_files

WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, n long, digest string, kept boolean, token string, label string, point long, h int, at string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def make_texts(seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéßЖ") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = prose(60)
    texts = [None, "", " \n\t ", "one", "One", "a b c", "A b C", "A b C", "x " * 300, "x y " * 200, "x " * 55, "x " * 52 + "z"]
    for _ in range(12):
        base = prose(rnd.randint(60, 260))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append("\n".join(copy) if rnd.random() < 0.5 else " ".join(copy).upper())
    for _ in range(10):
        own = prose(rnd.randint(5, 150))
        at = rnd.randrange(len(own))
        lo = rnd.randint(0, 12)
        texts.append(" ".join(own[:at] + passage[lo : lo + rnd.randint(45, 60)] + own[at:]))
    texts += [" ".join(passage)] * 8
    texts.append(" ".join(prose(9000)))  # very long
    texts.append("Licensed under the Apache License, Version 2.0.\n" + " ".join(prose(80)))
    texts.append("Licenced under the Apache Licence Version 2.0; MIT  license-mit LICENSE")
    texts.append(" ".join(prose(70)) + " GNU\nGeneral--Public License")
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = make_texts()
    ids = list(range(len(texts)))
    random.Random(7).shuffle(ids)
    out = [(i, t, ["en", "fr", None][i % 3], 1, "d", True, "t", "l", 3, 4, "a", 5) for i, t in zip(ids, texts, strict=True)]
    return out + out[20:23]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def with_null_id(spark, rows):
    return spark.createDataFrame([*rows, (None, "a b c", *rows[0][2:]), (None, rows[30][1], *rows[0][2:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(name, texts, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name)
    t.encode_special_tokens = True
    return [list(e.ids) + ([end] if end is not None else []) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_packing(docs, rows):
    got = packing.pack_documents(docs, WORD_VOCAB).collect()
    want = Counter()
    for r, ids in zip(rows, ids_of(WORD_VOCAB, [r[1] for r in rows], 2), strict=True):
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            want[r[0], a, len(part), crc(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 4096) * 1.1 + 2


def test_packing_many_pieces(spark):
    rnd = random.Random(3)
    parts = [(i, 0, min(4096, int(rnd.lognormvariate(6.3, 1))) or 1, i, 1) for i in range(20000)] + [(50000 + i, 0, 700, 0, 1) for i in range(10000)]
    df = spark.createDataFrame(parts, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack(df).select("sequence_id", "offset", "length").collect()
    assert len(got) == len(parts)
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096
    assert sum(room.values()) / (4096 * len(room)) > 0.97
    assert sorted(room) == list(range(len(room)))


def test_plan_uses_histogram_up():
    rnd = random.Random(1)
    for _ in range(5):
        h = {rnd.randint(1, 32): rnd.randint(1, 500) for _ in range(rnd.randint(1, 20))}
        used = Counter()
        for combo, n in packing.plan(h, 32):
            assert sum(k * m for k, m in combo.items()) <= 32
            for k, m in combo.items():
                used[k] += m * n
        assert used == Counter(h)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(with_null_id, rows, keep):
    got = exact_dedup.exact_groups(with_null_id, keep).collect()
    all_rows = [*rows, (None, "a b c"), (None, rows[30][1])]
    groups = defaultdict(list)
    for r in all_rows:
        groups[lower(r[1])].append(r[0])
    pick = {"max": max, "min": min}[keep]
    want = Counter()
    for r in all_rows:
        own = groups[lower(r[1])]
        best = pick([x for x in own if x is not None], default=None)
        want[r[0], best, len(own), r[0] == best, hashlib.sha256(lower(r[1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_drop_copies(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    best = {}
    for r in rows:
        best[lower(r[1])] = max(r[0], best.get(lower(r[1]), -1))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in rows if best[lower(r[1])] == r[0])


def test_drop_copies_one_row(with_null_id, rows, spark):
    extra = [(None, "all null", *rows[0][2:])] * 3 + [(900, t, *rows[0][2:]) for t in ("Twice here", "twice HERE", "twice here")]
    all_rows = [*rows, (None, "a b c", *rows[0][2:]), (None, rows[30][1], *rows[0][2:]), *extra]
    got = exact_dedup.drop_copies(with_null_id.unionByName(spark.createDataFrame(extra, SCHEMA)), one_row=True)
    assert got.columns == with_null_id.columns
    best = {}
    for r in all_rows:
        key = lower(r[1])
        best[key] = max([best.get(key, (-1, "")), (-1 if r[0] is None else r[0], "")])
    want = Counter((None if i < 0 else i, t) for t, (i, _) in best.items())
    got = got.collect()
    assert Counter((r.doc_id, lower(r.text)) for r in got) == want and [r.text for r in got if r.doc_id == 900] == ["Twice here"]


def test_token_files(docs, rows, spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    got = token_files.write_and_read(docs, BYTE_VOCAB, folder, file_ids=3000).collect()
    ids = ids_of(BYTE_VOCAB, [r[1] for r in rows], 2)
    at, want = 0, Counter()
    for _, i, _, own in sorted((r[0], k, r[1] or "", x) for k, (r, x) in enumerate(zip(rows, ids, strict=True))):
        want[rows[i][0], at, len(own), crc(own)] += 1
        at += len(own)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("seed", range(4))
def test_token_file_round_trip(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.integers(0, 700, 9).tolist()
    ids = rnd.integers(0, [2, 300, 50_000, 2**32][seed], sum(lengths)).astype(np.uint32)
    keys = [None, -5, *range(7)]
    k, n, back = token_files.load(token_files.dump(keys, lengths, ids))
    assert (k, n.tolist(), back.tolist()) == (keys, lengths, ids.tolist())


def test_license_scan(docs, rows):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()}
    want = set()
    for r in rows:
        w = words(lower(r[1]))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        want.add((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got == want


def test_license_notices():
    n = license_scan.Notices(license_scan.NOTICES)
    r = license_scan.scan_text("É a. Licenced under teh Apache Licens, Version 2.0", license_scan.PHRASES, n)
    assert r["base_labels"] == "" and r["labels"] == "apache" and r["spans"][0][1:3] == (2, 10) and 0 < r["score"] < 1
    assert license_scan.scan_text("MIT license mit LICENSE", license_scan.PHRASES, n)["n_base"] == 2
    assert license_scan.scan_text(None, license_scan.PHRASES, n)["labels"] == ""


def test_misspelt_phrases():
    n = license_scan.Notices(license_scan.NOTICES)
    label = lambda t: license_scan.scan_text(t, license_scan.PHRASES, n)["labels"]
    assert label("this program is licensed under the GNU General Public Licence, version 2 or later") == "gpl"
    assert label("GNU general pubic license") == label("released under gnu general public licence 3") == "gpl"
    assert label("Apache Licence") == label("the apache lisence,") == "apache" and label("MIT Licence") == label("(mit licnse)") == "mit"
    assert label("to submit licence fees") == label("permit license") == label("apache licensesxx") == label("general public") == ""
    assert label("gnu lesser general public license") == "lgpl" and label("gnu affero general public license") == "agpl"


def test_notices_before_a_better_one():
    n = license_scan.Notices(license_scan.NOTICES)
    text = "gnu lesser general public licence or gnu lesser general public license and gnu leser general publc license"
    assert [(s.first, s.last, s.edits) for s in n.spans(text)] == [(0, 5, 1), (6, 11, 0), (12, 17, 2)]
    odd = license_scan.Notices((("ab", "x", 2), ("abcd", "y", 1)))  # a notice that may be empty; the search ends
    assert {s.label for s in odd.spans("ab abcd abxd ab")} == {"x", "y"}


def brute_repeats(w, least):
    lens = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        lens.append(best if best >= least else 0)
    return lens


def test_repetition():
    rnd = random.Random(1)
    texts = ["", None, "a", "a " * 70, "x y " * 40, "k\nk\n\n \nk"]
    texts += ["".join(rnd.choice("abcäöü#&é日本"[: rnd.choice([2, 3, 12])]) + rnd.choice([" ", "\n", "\t", "  "]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    m = repetition.measure(texts)
    for i, t in enumerate(texts):
        w = SPLIT(t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for j in range(3)}
        lens = brute_repeats(w, repetition.MIN_REPEAT)
        cover = {i + j for i, n in enumerate(lens) for j in range(n)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if SPLIT(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeated), len(cover), max(lens, default=0))
        assert tuple(m[k][i] for k in m) == want, t


def test_quality_rows(with_null_id, rows):
    got = repetition.quality(with_null_id).collect()
    assert len(got) == len(rows) + 2
    kept = Counter(r.doc_id for r in got if r.kept)
    assert Counter(r.doc_id for r in repetition.keep_good(with_null_id).collect()) == kept
    assert all(r.base_failed for r in got if r.n_words < 50)


def shingles(t, size=4):
    w = SPLIT(lower(t))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_components(pairs, size=4, percent=85):
    ids = [i for i, _ in pairs]
    sets = [shingles(t, size) for _, t in pairs]
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def as_counter(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_jaccard_components(docs, rows):
    assert as_counter(jaccard_join.jaccard_components(docs)) == brute_components([(r[0], r[1]) for r in rows])


def test_jaccard_chains(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(3000)}" for _ in range(90)]
    pairs = []
    for k in range(80):  # a large group whose members are mostly further apart than the threshold
        if k % 3 == 0:
            base = list(base)
            base[rnd.randrange(90)] = f"v{k}"
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(90)] = f"u{rnd.randrange(10**6)}"
        pairs.append((k * 3 % 80, " ".join(own)))
    df = spark.createDataFrame([(i, t, "x") for i, t in pairs], "doc_id long, text string, n string")
    assert as_counter(jaccard_join.jaccard_components(df)) == brute_components(pairs)


def test_near_copies_that_stay(docs, rows):
    want = {d for d, _, c in brute_components([(r[0], r[1]) for r in rows]) if d == c}
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_near_copies_of_clashing_ids(spark):
    rnd = random.Random(3)
    base, own, other = ([f"w{rnd.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    pairs = [
        (1, " ".join(base)), (2, near(base, 50)), (2, " ".join(own)), (2, ""),  # 2: a copy goes, a text of its own and an empty one stay
        (3, near(base, 20)), (3, near(base, 70)),  # all of it goes
        (4, " ".join(other)), (4, near(other, 99)), (5, near(other, 0)), (None, near(base, 30)),
    ]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in pairs], "doc_id long, text string, label string, point int")
    got = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect())
    four = [p for p in pairs if p[0] == 4]
    fixed = Counter([pairs[0], pairs[2], pairs[3], pairs[-1]])
    assert got in [fixed + Counter([p]) for p in four]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (200, 9), (7, 8)]
    got = {r.node: r.label for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3, 200: 3, 7: 7, 8: 7}


def test_byte_bpe(docs, rows):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), sha(ids), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want


def test_byte_bpe_odd_texts():
    import tiktoken

    b = byte_bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    assert sorted(b.hash.number) == list(range(b.hash.n)) and all(b.hash.index(k) == i for i, k in enumerate(b.keys)) and b.hash.index(b"\xff\xfe zz") == -1
    rnd = random.Random(2)
    for _ in range(1500):
        t = "".join(rnd.choice("abthe  \n\t'st.,!é日Ж1²\x1c\xa0_-llǅ́") for _ in range(rnd.randint(0, 60)))
        ids = b.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t) and b.decode(ids).decode() == t


def brute_removed(pairs, window=50):
    first = {}
    for d, t in pairs:
        w = SPLIT(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = Counter()
    for d, t in pairs:
        w = SPLIT(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out[d, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
    return out


def test_recompression(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.removed(docs).collect())
    assert got == brute_removed([(r[0], r[1]) for r in rows])


def test_recompression_periodic_texts(spark):
    rnd = random.Random(4)
    pairs = []
    for k in range(120):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 5))]
            parts += (unit * 60)[: rnd.randint(1, 90)]
        pairs.append((k, " ".join(parts)))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.removed(df).collect())
    assert got == brute_removed(pairs)


def test_texts_without_repeats(docs, rows):
    got = recompression.without_repeats(docs)
    assert got.columns == docs.columns
    want = {(d, h) for d, _, n, h in brute_removed([(r[0], r[1]) for r in rows])}
    assert {(r.doc_id, hashlib.sha256(" ".join(SPLIT(r.text or "")).encode()).hexdigest()) for r in got.collect()} == want


def test_language(spark):
    rnd = random.Random(3)
    langs = {"aa": "ka lo mi shu re ta na".split(), "bb": "über größe straß münch äpfel zung".split(), "cc": "où être garçon déjà noël".split()}
    out = []
    for i in range(400):
        name = rnd.choice(list(langs))
        out.append((i, " ".join(rnd.choice(langs[name]) for _ in range(rnd.randint(8, 60))), name, 0))
    out += [(400, None, "aa", 0), (401, "12 ** 3", "aa", 0), (402, "", None, 0), (403, "ka lo mi shu", None, 0), (None, "ka lo mi shu", "aa", 0)]
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, label int")
    got = {r.doc_id: r for r in hyperdim.identify(df).collect()}
    assert len(got) == len(out)
    for r in out[:400]:
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
    tested = [r for r in out[:400] if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in tested) >= 0.97 * len(tested) > 30
    assert [got[k].lang_pred for k in (400, 401, 402, 403)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_tables(empty):
    assert packing.pack_documents(empty, WORD_VOCAB).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert token_files.write_and_read(empty, BYTE_VOCAB).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert repetition.quality(empty).count() == 0
    assert repetition.keep_good(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0
    assert byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert recompression.removed(empty).count() == 0
    assert recompression.without_repeats(empty).count() == 0
    assert hyperdim.identify(empty).count() == 0


def test_null_ids(with_null_id, rows):
    n = len(rows) + 2
    assert sum(r.doc_id is None for r in packing.pack_documents(with_null_id, WORD_VOCAB).collect()) == 2
    first = token_files.write_and_read(with_null_id, BYTE_VOCAB).orderBy("start").limit(2).collect()
    assert [r.doc_id for r in first] == [None, None]
    near = jaccard_join.jaccard_components(with_null_id).collect()
    assert len(near) == n and all(r.component_id is None for r in near if r.doc_id is None)
    cut = recompression.removed(with_null_id).collect()
    assert len(cut) == n and all(r.n_removed == 0 for r in cut if r.doc_id is None)
    assert recompression.without_repeats(with_null_id).count() == n
    assert license_scan.scan(with_null_id).count() == hyperdim.identify(with_null_id).count() == n


def test_documents_that_share_most_words_make_few_pairs(spark, monkeypatch):
    """180 common and 20 own words: no two link, and hardly any two are compared."""
    common = [f"c{k}" for k in range(180)]
    docs = [(d, " ".join([*common, *(f"own{d}x{k}" for k in range(20))]), *[None] * 10) for d in range(150)]
    looked, real = [], jaccard_join.distances
    monkeypatch.setattr(jaccard_join, "distances", lambda pairs, sets: looked.append(pairs.count()) or real(pairs, sets))
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == set(range(150))
    assert sum(looked) <= 150
