"""The pipeline's stages on small tables, and all of it against plain Python."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_operators import SPLIT, WORD_VOCAB, brute_repeats, crc, ids_of, lower, shingles


def plain_quality(rows):
    out = []
    for d, t in rows:
        w = SPLIT(t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for j in range(3)}
        lens = brute_repeats(w, 8)
        cover = {i + j for i, n in enumerate(lens) for j in range(n)}
        longest = max(lens, default=0)
        if len(w) >= 50 and len(repeated) <= 0.5 * len(w) and len(cover) <= 0.3 * len(w) and not (longest >= 50 and longest > 0.3 * len(w)):
            out.append((d, t))
    return out


def plain_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append((d is not None, d or 0, t))
    out = []
    for own in groups.values():
        known, d, _ = max(own, key=lambda x: x[:2])
        out.append((d if known else None, min(t for k, i, t in own if (k, i) == (known, d))))
    return out


def plain_near(rows):
    sets = [shingles(t, 5) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    least = {}
    for k, (d, _) in zip(of, rows, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [(d, t) for k, (d, t) in zip(of, rows, strict=True) if d is None or least[k] == d]


def plain_passages(rows):
    first = {}
    windows = lambda t: [tuple(w[i : i + 50]) for w in [SPLIT(t)] for i in range(len(w) - 49)]
    for d, t in rows:
        for k in windows(t) if d is not None else []:
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        gone = {i + j for i, k in enumerate(windows(t)) if d is not None and first[k] < d for j in range(50)}
        out.append((d, " ".join(x for i, x in enumerate(SPLIT(t)) if i not in gone) if gone else t))
    return out


def plain_pieces(rows):
    out = Counter()
    for (d, _), ids in zip(rows, ids_of(WORD_VOCAB, [t for _, t in rows], 2), strict=True):
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            out[d, a, len(part), crc(part), len(ids)] += 1
    return out


def planted():
    rnd = random.Random(19)
    prose = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}" for _ in range(n)]
    passage = prose(70)
    texts = [" ".join(prose(rnd.randint(60, 200))) for _ in range(14)]
    texts += [None, "", "too short", "x y " * 60, " ".join(prose(60) * 2)]  # rejects
    texts += [texts[0], texts[0].upper(), texts[1], texts[1]]  # exact copies
    for k in (2, 2, 3):  # near copies
        w = texts[k].split()
        texts.append(" ".join([*w[:30], "changed", *w[31:]]))
    base = prose(200)
    texts += [" ".join(base), " ".join("new" + w if k in (30, 70, 110, 150) else w for k, w in enumerate(base))]  # only five words and 0.8 link these
    for n in (50, 60, 55):  # shared passages
        texts.append(" ".join(prose(80) + passage[:n] + prose(40)))
    texts += [" ".join(passage), " ".join(passage + prose(300)), " ".join(prose(5000))]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[5], rows[5], (None, " ".join(prose(90))), (None, texts[7])]  # repeated rows and null ids
    rows += [rows[-2], (rows[24][0], " ".join(prose(100)))]  # a null id's row again; a near copy's id with a text of its own
    return rows


def test_run_against_plain_stages(spark, tmp_path):
    rows = planted()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = [len(rows)]
    for stage in (plain_quality, plain_exact, plain_near):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes == sorted(set(sizes), reverse=True)  # each of them takes rows
    new = plain_passages(rows)
    assert new != rows
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == plain_pieces(new)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_near_copies_of_five_words(spark):
    base = [f"w{k}" for k in range(200)]
    copy = [f"v{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(base)]  # 0.815 on five words, 0.8498 on four
    far = [f"u{k}" if k in (30, 60, 90, 120, 150) else w for k, w in enumerate(base)]  # 0.774 on five words
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()] == [1]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [1, 2]
