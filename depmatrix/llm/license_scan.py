"""Fuzzy search for short license notices: pigeonhole seeds, then bounded-error matching.

A notice that may differ in k edits is cut into k + 1 pieces, one of which stands unchanged in any match. One automaton finds
all pieces of all notices; around each find the regex library decides within k edits and gives the span.

The words of a notice that tell licenses apart (its key) are held to a stricter limit than the rest, as "released under the old license" is three edits from the
MIT notice: a run of key words stands whole, between word boundaries, with fewer edits than lead to any other license's name, and with none if a word in it is short (mit, gnu, by nc).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.llm.shared import byte_table, string_parts

#: Phrases that count exactly, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices in words as the scanner reads them label, edits allowed, runs of key words in order.
NOTICES = (
    ("released under the mit license", "mit", 3, ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7, ()),
    ("licensed under the apache license version 2 0", "apache-2", 4, ("apache", "2")),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2, ("cc by nc",)),
    ("licensed under cc by 4 0", "cc-by", 1, ("cc by 4 0",)),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1, ("cc by sa",)),
    ("licensed under the gnu general public license", "gpl", 4, ("gnu",)),
    ("licensed under the gnu lesser general public license", "lgpl", 4, ("gnu",)),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 7, ("mozilla",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8, ()),
    ("all rights reserved", "all-rights-reserved", 1, ()),
)
#: Names of licenses, which a key may not be taken for.
NAMES = tuple("academic affero agpl apache artistic boost bsd cddl cecill eclipse epl eupl gnu gpl isc lgpl mit mozilla mpl openssl perl php postgresql python qpl ruby sleepycat unlicense wtfpl zlib zope".split())
#: A run of key words with a shorter word may have no edits.
KEY_LETTERS = 6
_SPACED = byte_table("ascii").spaced()


def distance(a: str, b: str) -> int:
    """Edits from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    keys: tuple[str, ...] = ()

    def parts(self) -> list[tuple[str, bool, int]]:
        """(stretch of the notice, whether it is key, edits it may have)."""
        out, rest = [], self.text
        for key in self.keys:
            before, _, rest = rest.partition(key)
            free = 0 if min(map(len, key.split())) < KEY_LETTERS else min(distance(key, x) for x in NAMES if x != key) - 1
            out += [(before, False, self.edits), (key, True, min(free, self.edits))]
        return [x for x in [*out, (rest, False, self.edits)] if x[0]]

    def pattern(self) -> str:
        fuzzy = lambda part, free: (
            f"(?:{regex.escape(part, literal_spaces=True)}){{e<={free}}}" if free else regex.escape(part, literal_spaces=True)
        )
        return (
            "(?b)"
            + "".join(f"(?<![^ ]){fuzzy(part, free)}(?![^ ])" if key else fuzzy(part, free) for part, key, free in self.parts())
            + "(?![^ ])"
        )

    def pieces(self) -> list[tuple[int, str]]:
        """(where it starts, piece): edits + 1 pieces of about equal length."""
        n, k = len(self.text), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple, ...]):
    known = [Notice(*x) for x in notices]
    seeds = ahocorasick.Automaton()
    held: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(known):
        for at, piece in n.pieces():
            held.setdefault(piece, []).append((i, at))
    for piece, where in held.items():
        seeds.add_word(piece, (len(piece), where))
    seeds.make_automaton()
    fixed = [[part for part, key, free in n.parts() if key and not free] for n in known]
    return known, seeds, [regex.compile(n.pattern()) for n in known], fixed


def _matches(line: str, notice: Notice, pattern: regex.Pattern, begins: set[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the best match at each word near which a piece puts the notice's start; overlapping ones give way to the best."""
    found, tried = [], set()
    for begin in begins:
        for start in range(max(0, begin - notice.edits), min(len(line), begin + notice.edits + 1)):
            if start in tried or start and line[start - 1] != " ":
                continue
            tried.add(start)
            m = pattern.match(line, start, min(len(line), start + len(notice.text) + notice.edits + 1))
            # the end of the stretch looks like the line's, so the match's end is checked again; edits of all parts count together
            if m and sum(m.fuzzy_counts) <= notice.edits and (m.end() == len(line) or line[m.end()] == " "):
                found.append((sum(m.fuzzy_counts), start, m.end()))
    taken: list[tuple[int, int]] = []
    for edits, start, end in sorted(found):
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            yield start, end, edits


def scan(
    text: bytes, notices: tuple[tuple, ...] = NOTICES
) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, int, float]]]:
    """(words, exact places as (label, first word, words), fuzzy matches as (label, first word, last word, edits, score)).

    Bytes beyond ASCII are letters; an edit in them counts once for each byte."""
    words = text.translate(_SPACED).split()
    line = b" ".join(words).decode("latin-1")
    known, seeds, match, fixed = _scanner(notices)
    exact = []
    starts: np.ndarray | None = None

    def place(at: int) -> int:
        nonlocal starts
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        return int(np.searchsorted(starts, at))

    for phrase, label in PHRASES.items():
        at = line.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
                exact.append((label, place(at), phrase.count(" ") + 1))
            at = line.find(phrase, at + 1)
    near: list[set[int]] = [set() for _ in known]
    for last, (length, where) in seeds.iter(line):
        for i, at in where:
            near[i].add(last - length + 1 - at)
    fuzzy = []
    for i, begins in enumerate(near):
        n = known[i]
        if fixed[i] and begins:  # a key without edits must stand there
            reach = len(n.text) + 2 * n.edits
            begins = {b for b in begins if all(line.find(part, max(0, b - n.edits), b + reach) >= 0 for part in fixed[i])}
        for start, end, edits in _matches(line, n, match[i], begins):
            fuzzy.append((n.label, place(start), place(end - 1), edits, 1 - edits / len(n.text)))
    return len(words), exact, sorted(fuzzy, key=lambda x: (x[1], x[0]))


SPANS = "array<struct<label:string,first_word:long,last_word:long,edits:long,score:double>>"
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans "
    f"{SPANS}"
)


def license_scan(docs: DataFrame, notices: tuple[tuple, ...] = NOTICES) -> DataFrame:
    """One row per row of docs (doc_id, text): the columns of RESULT. labels holds exact and fuzzy ones; score is that of the best match.

    Null or empty text: no words, no labels (empty strings), score 0. Repeated rows come out alike. Extra columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_parts(batch.column(1))
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, exact, fuzzy = scan(data[a:b].tobytes(), notices)
                starts = [x[1] for x in exact]
                base = {x[0] for x in exact}
                spans = [
                    dict(zip(("label", "first_word", "last_word", "edits", "score"), (x, f, f + k - 1, 0, 1.0), strict=True))
                    for x, f, k in exact
                ]
                spans += [dict(zip(("label", "first_word", "last_word", "edits", "score"), x, strict=True)) for x in fuzzy]
                rows.append(
                    (
                        doc,
                        n,
                        len(exact),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {x[0] for x in fuzzy})),
                        max((s["score"] for s in spans), default=0.0),
                        spans,
                    )
                )
            span = pa.struct(
                [
                    ("label", pa.string()),
                    ("first_word", pa.int64()),
                    ("last_word", pa.int64()),
                    ("edits", pa.int64()),
                    ("score", pa.float64()),
                ]
            )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
