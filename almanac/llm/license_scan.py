"""License scans: exact phrases, and short notices with errors.

A text is lower-cased (A-Z only) and cut into words; its words joined by single spaces are searched.
Exact phrases are found at every place. A notice that may differ in up to k edits is split into
k + 1 seeds: by the pigeonhole principle one of them stands unchanged in every match. An
Aho-Corasick automaton finds the seeds of all notices in one pass, each hit gives a window of the
notice's length plus k on either side, and the regex library's bounded-error matching verifies the
windows and reports span and edits. Of overlapping matches of one notice the one with the fewest edits stays,
then the first.

Defined results: null or empty text has no words and no labels (empty strings, score 0); rows are
scanned on their own, whole, in time proportional to their length.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import bounded_batches, columns

#: Phrases and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (notice, label, edits). A notice is written in words joined by single spaces; one with a space at
#: both ends must begin and end where words do.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("this work is licensed under the gnu general public license version 3", "gpl", 5),
    ("gnu general public license", "gpl", 2),
    (" apache license ", "apache", 2),
    (" mit license ", "mit", 1),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by sa", "cc-by-sa", 2),
    ("creative commons attribution", "cc-by", 2),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
)
#: Parts of texts whose best match is kept.
KNOWN = 20_000
#: Bytes that are no part of a word, as spaces; A-Z as a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Span:
    """A notice found: label, first and last word + 1, edits."""

    label: str
    first: int
    last: int
    edits: int


class Notices:
    """Scanner for notices with up to k edits each."""

    def __init__(self, notices: tuple[tuple[str, str, int], ...]):
        self.notices = tuple((text.strip(" "), label, k) for text, label, k in notices)
        edges = [(r"(?<![^ ])", r"(?![^ ])") if text[:1] == text[-1:] == " " else ("", "") for text, _, _ in notices]
        self.patterns = [regex.compile(f"(?b){a}(?:{regex.escape(text, special_only=True)}){{e<={k}}}{b}") for (text, _, k), (a, b) in zip(self.notices, edges, strict=True)]
        #: Characters on either side of a notice: its edits, and the neighbour that a word's end is seen by.
        self.margins = [k + bool(a) for (_, _, k), (a, _) in zip(self.notices, edges, strict=True)]
        self.known: dict[tuple[int, str, int], tuple[int, int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k) in enumerate(self.notices):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((i, a))
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        if seeds:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """For each notice the windows in which a match may lie, one for each place its seeds point at."""
        found: dict[int, set[tuple[int, int]]] = {}
        if not len(self.automaton):
            return found
        for end, (size, places) in self.automaton.iter(text):
            for i, a in places:
                k = self.margins[i]
                start = end + 1 - size - a
                found.setdefault(i, set()).add((max(0, start - k), min(len(text), start + len(self.notices[i][0]) + k)))
        return found

    def best(self, i: int, part: str, at: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of notice i in ``part`` from ``at`` on. Notices are mostly copies
        of each other, so the last parts are kept."""
        key = (i, part, at)
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            m = self.patterns[i].search(part, at)
            self.known[key] = (sum(m.fuzzy_counts), m.start(), m.end()) if m else None
        return self.known[key]

    def matches(self, i: int, text: str, windows: set[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(edits, start, end) of notice i, fewest edits first, none overlapping an earlier one. A window holds
        little more than one notice, and what an accepted match leaves of it is searched again, so the time
        is in proportion to the windows."""
        least = max(1, len(self.notices[i][0]) - self.notices[i][2])
        heap: list[tuple[int, int, int, int, int]] = []
        starts: list[int] = []
        ends: list[int] = []

        def search(lo: int, hi: int) -> None:
            if hi - lo >= least:
                edge = min(lo, 1)  # the character before, which a notice's edge looks at
                if found := self.best(i, text[lo - edge : hi], edge):
                    edits, start, end = found
                    heapq.heappush(heap, (edits, lo - edge + start, lo - edge + end, lo, hi))

        for lo, hi in windows:
            search(lo, hi)
        while heap:
            edits, start, end, lo, hi = heapq.heappop(heap)
            at = bisect.bisect_right(starts, start)
            taken = at > 0 and (starts[at - 1], ends[at - 1]) == (start, end)
            before = at > 0 and not taken and ends[at - 1] > start
            if before or (not taken and at < len(starts) and starts[at] < end):
                # What accepted matches leave of the window.
                first = at - 1 if before else at
                while first > 0 and ends[first - 1] > lo:
                    first -= 1
                while first < len(starts) and starts[first] < hi:
                    search(lo, starts[first])
                    lo = max(lo, ends[first])
                    first += 1
                search(lo, hi)
                continue
            if not taken:
                starts.insert(at, start)
                ends.insert(at, end)
                yield edits, start, end
            search(lo, min(start, hi - 1))
            search(max(end, lo + 1), hi)

    def spans(self, text: str) -> list[Span]:
        out = []
        windows = self.windows(text)
        spaces = [m.start() for m in re.finditer(" ", text)] if windows else []
        for i, own in windows.items():
            for edits, start, end in self.matches(i, text, own):
                first = bisect.bisect_left(spaces, start + (text[start : start + 1] == " "))
                last = bisect.bisect_left(spaces, end - (end > 0 and text[end - 1] == " ")) + 1
                out.append(Span(self.notices[i][1], first, last, edits))
        # A notice gives way to a better one that it overlaps, but not to its own label's shorter form in it.
        out.sort(key=lambda s: (s.first, s.last, s.label))
        firsts = [s.first for s in out]
        longest = max((s.last - s.first for s in out), default=0)

        def gives_way(s: Span) -> bool:
            near = out[bisect.bisect_right(firsts, s.first - longest) : bisect.bisect_left(firsts, s.last)]
            part = lambda x: x.label == s.label and s.first <= x.first and x.last <= s.last
            return any(s.first < x.last and x.edits < s.edits and not part(x) for x in near)

        return [s for s in out if not gives_way(s)]


def scan_text(text: str | None, phrases: dict[str, str], notices: Notices) -> dict:
    """All a row reports; words count from 0."""
    words = (text or "").encode().translate(TABLE).split()
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at, word, counted = padded.find(needle), 0, 0
        while at >= 0:
            word += padded.count(b" ", counted, at)
            counted = at
            places.append(word)
            base.add(label)
            at = padded.find(needle, at + 1)
    spans = notices.spans(joined.decode("utf-8", "surrogateescape"))
    best = max([1.0 for _ in places] + [1 / (1 + s.edits) for s in spans], default=0.0)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s.label for s in spans})),
        "score": best,
        "spans": [(s.label, s.first, s.last, s.edits) for s in spans],
    }


SPANS = "array<struct<label:string,first:int,last:int,edits:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """One row per document; ``spans`` lists the notices found with their words and edits."""
    wanted = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Notices(notices)
        span = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("edits", pa.int32())])
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            rows = [scan_text(t, wanted, scanner) for t in texts]
            for r in rows:
                r["spans"] = [dict(zip(("label", "first", "last", "edits"), s, strict=True)) for s in r["spans"]]
            names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
            arrays = [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], names=["doc_id", *names])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
