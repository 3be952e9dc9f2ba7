"""License scans: exact phrases of words, and a fuzzy search for short notices.

A notice of m characters with at most e edits, cut into e + 1 pieces, keeps one piece unchanged (pigeonhole). All notices' pieces are
found at once by an Aho-Corasick automaton; around each hit the regex library matches the notice with at most e errors and reports its
span. The words and numbers that tell a license from its neighbours (in braces below) admit no edit, and end where they end. Both searches
work on whole texts with ASCII letters in lower case.
"""

from __future__ import annotations

import bisect
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from podium.llm.common import texts
from podium.llm.tokens import slices

#: Phrases of words and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, with what decides between them in braces, and their labels.
NOTICES = {
    "licensed under the {gnu general public} license, {version 2}": "gpl-2",
    "licensed under the {gnu general public} license, {version 3}": "gpl-3",
    "licensed under the {gnu lesser general public} license": "lgpl",
    "licensed under the {gnu affero general public} license": "agpl",
    "licensed under the {apache} license, {version 1.1}": "apache-1.1",
    "licensed under the {apache} license, {version 2.0}": "apache-2.0",
    "released under the {mit} license": "mit",
    "released under the {bsd} license": "bsd",
    "released under the {isc} license": "isc",
    "licensed under {cc by} 4.0": "cc-by",
    "licensed under {cc by-nc} 4.0": "cc-by-nc",
    "licensed under {cc by-nd} 4.0": "cc-by-nd",
    "licensed under {cc by-sa} 4.0": "cc-by-sa",
    "licensed under {cc by-nc-nd} 4.0": "cc-by-nc-nd",
    "licensed under {cc by-nc-sa} 4.0": "cc-by-nc-sa",
    "licensed under the creative commons {attribution}": "cc-by",
    "licensed under the creative commons {attribution-noncommercial}": "cc-by-nc",
    "licensed under the creative commons {attribution-noderivatives}": "cc-by-nd",
    "licensed under the creative commons {attribution-sharealike}": "cc-by-sa",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms, with or without modification": "bsd",
    "subject to the terms of the {mozilla} public license": "mpl",
    "spdx-license-identifier:": "spdx",
}
#: How a deciding part may be written, where not only as it stands; and what may not stand around one.
WRITTEN = {
    "version 2": "version 2(?:[.]0)?",
    "version 3": "version 3(?:[.]0)?",
    "version 2.0": "version 2(?:[.]0)?",
    "attribution": "attribution(?! ?non| ?no| ?share)",
    "attribution-noncommercial": "attribution[- ]non-?commercial",
    "attribution-noderivatives": "attribution[- ]no-?deriv(?:ative)?s",
    "attribution-sharealike": "attribution[- ]share-?alike",
}
BEFORE, BEHIND = r"(?<![\w.])", r"(?!\w|-[a-z]|[.]\d)"
#: Edits allowed: one for so many characters; characters that a deciding part may be longer by than it stands, or that are looked at behind it.
PER_EDIT, REACH = 10, 8

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_SPACED = np.where(_IS_WORD, np.arange(256), 0x20).astype(np.uint8)


def edits(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


def seeds(notice: str) -> list[tuple[int, str]]:
    """The pieces of a notice and where they begin: one more than it may have edits."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Notice:
    """A notice: its characters, the errors that it may have, and a pattern of its parts, the deciding ones exact."""

    def __init__(self, marked: str, label: str):
        parts = re.split(r"[{}]", marked)  # every other one decides
        self.label, self.text = label, "".join(parts)
        self.edits = edits(self.text)
        exact = lambda x: BEFORE + "(?:" + WRITTEN.get(x, regex.escape(x)) + ")" + BEHIND
        fuzzy = lambda x: f"(?:{regex.escape(x)}){{e<={self.edits}}}" if x else ""
        self.pattern = regex.compile("".join(exact(x) if i % 2 else fuzzy(x) for i, x in enumerate(parts)), regex.BESTMATCH)

    def match(self, low: str, start: int, stop: int) -> tuple[int, int, int] | None:
        """Start, end and errors of the best match there."""
        hit = self.pattern.search(low, max(0, start), stop)
        return (*hit.span(), sum(hit.fuzzy_counts)) if hit and sum(hit.fuzzy_counts) <= self.edits else None


#: White space and what wraps comments around it, where it is more than one blank or another sign than that.
WRAP = re.compile(r"[*#/]*\s[\s*#/]+|[*#/]+\s|[^\S ]")


def folded(low: str) -> tuple[str, list[int], list[int]]:
    """The text with each wrap as one blank, so that edits measure edits; where wraps end in it, and by how much places behind them lie further on
    in the text itself."""
    out, ends, shifts, last, size = [], [], [0], 0, 0
    for m in WRAP.finditer(low):
        out += [low[last : m.start()], " "]
        size += m.start() - last + 1
        last = m.end()
        ends.append(size)
        shifts.append(last - size)
    return ("".join([*out, low[last:]]) if ends else low), ends, shifts


class Searcher:
    """Finds the notices in a text."""

    def __init__(self, notices: dict[str, str] = NOTICES):
        self.notices = [Notice(*x) for x in notices.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.notices):
            for at, piece in seeds(x.text):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, low: str) -> list[tuple[str, int, int, int, float]]:
        """label, start, end, errors and score (1 less the share of the notice's characters that are edited) of each notice found in a text in
        lower case, by start; a stretch of text is one notice's once, the nearest one's. Line breaks and comment signs at them are as one blank."""
        low, ends, shifts = folded(low)
        there = lambda p: p + shifts[bisect.bisect_right(ends, p)]
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for end, (size, where) in self.automaton.iter(low):
            for k, at in where:
                notice = self.notices[k]
                begin, seed = end + 1 - size - at, end + 1 - size
                seen = spans.setdefault(k, [])
                if any(a <= seed and end < b for a, b, _ in seen[-2:]):
                    continue
                if hit := notice.match(low, begin - notice.edits, begin + len(notice.text) + notice.edits + REACH):
                    if not any(a < hit[1] and hit[0] < b for a, b, _ in seen[-2:]):
                        seen.append(hit)
        best: list[tuple[int, int, int, int]] = []
        for _, _, a, b, n, k in sorted((n, -len(self.notices[k].text), a, b, n, k) for k, found in spans.items() for a, b, n in found):
            if all(b <= c or d <= a for c, d, _, _ in best):  # of notices at the same place the nearest, the longer of equally near ones
                best.append((a, b, n, k))
        return [(self.notices[k].label, there(a), there(b - 1) + 1, n, 1 - n / len(self.notices[k].text)) for a, b, n, k in sorted(best)]


_SEARCHER: list[Searcher] = []


def _searcher() -> Searcher:
    if not _SEARCHER:
        _SEARCHER.append(Searcher())
    return _SEARCHER[0]


def phrases(raw: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """Of texts in lower case: the number of words of each, and its phrases as (first word, label)."""
    data = np.frombuffer(b"\0".join(raw), np.uint8)
    bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
    inside = _IS_WORD[data]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    counts = np.searchsorted(first, bounds)
    spaced = _SPACED[data]
    spaced[bounds[1:-1] - 1] = 0
    flat = spaced.tobytes()
    found: list[list[tuple[int, str]]] = [[] for _ in raw]
    for phrase, label in PHRASES.items():
        for hit in re.finditer(rb" +".join(phrase.encode().split()), flat):
            a, b = hit.span()
            if (a == 0 or flat[a - 1] in b" \0") and (b == len(flat) or flat[b] in b" \0"):
                doc = int(np.searchsorted(bounds, a, side="right")) - 1
                found[doc].append((int(np.searchsorted(first, a) - counts[doc]), label))
    return np.diff(counts), found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    labels holds the phrases' and the notices' labels; score is 1 less the share of a notice's characters that are edited, of the best
    span (1 for a phrase, 0 without any); spans is a JSON list of [label, start, end, errors] in code points. A null or empty text has no
    words and empty labels. Equal rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def run(batches):
        searcher = _searcher()
        for batch in slices(batches):
            raw = [x.as_buffer().to_pybytes().lower() for x in batch.column("text").cast(pa.binary())]
            counts, found = phrases(raw)
            rows = []
            for doc, text, n, base in zip(batch.column("doc_id").to_pylist(), raw, counts.tolist(), found, strict=True):
                spans = searcher.find(text.decode("utf-8", "replace"))
                own, at = {x for _, x in base}, [k for k, _ in base]
                score = 1.0 if base else max((x[4] for x in spans), default=0.0)
                rows.append((doc, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, *_ in spans})), score, json.dumps([x[:4] for x in spans])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
