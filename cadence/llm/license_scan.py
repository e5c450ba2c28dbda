"""License scans: short notices found in whole texts, with edits.

A text is read as its words, A-Z lower-cased, joined by single spaces.  A *place* of a
notice is a run of whole words that differs from the notice in at most ``len // EVERY``
characters put in, left out or changed.  Cut into one more piece than edits are allowed,
a notice keeps at least one piece unchanged wherever it stands (pigeonhole), and that
piece stands at most that many characters off.  So the pieces of all notices are looked
up at once by an automaton, each hit names the few runs of words that may be a place,
and the ``regex`` library's bounded-error matching decides and counts the edits.  Of
places that overlap, the one with the fewest edits stays (ties: the longer notice, the
earlier place, the label), so a notice of another license is not taken for a misspelt one.

The base phrases are searched word by word beside that; their labels always stay.

Texts are handled row by row in Arrow batches, nothing is shuffled, and the work is
linear in the text but for the hits.  Defined results: a null text is empty; without
words or places counts are 0, word numbers null, labels empty and the score 0; repeated
rows give repeated results; columns that clash with new ones are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from cadence.llm.common import with_text_columns

#: Characters of a notice for which one edit is allowed.
EVERY = 12

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Notices that are found with edits, and their labels.
NOTICES = (
    ("under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("apache license version 2", "apache-2"),
    ("apache license version 1", "apache-1"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("cc0 1 0 universal", "cc0"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_IN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in _WORD_BYTES)


class Place(NamedTuple):
    """A notice in a text: words from ``first_word``, edits, and code points of the text."""

    label: str
    notice: str
    errors: int
    first_word: int
    n_words: int
    start: int = -1
    end: int = -1


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "notices array<struct<label: string, notice: string, errors: int, first_word: long, n_words: long, start: long, end: long>>")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def base_places(joined: bytes, phrases=BASE) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words follow each other.
    ``joined`` holds the words with a space before, between and after them."""
    out = []
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at, before, counted = joined.find(sought), 0, 0
        while at >= 0:
            before += joined.count(b" ", counted, at)
            counted = at
            out.append((before, label))
            at = joined.find(sought, at + 1)
    return out


def allowed(notice: str) -> int:
    return len(notice) // EVERY


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): one more piece than edits are allowed, of nearly equal length."""
    n = allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str], ...]):
    """(automaton of pieces, bounded-error matcher of every notice)."""
    import ahocorasick
    import regex

    owners: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _) in enumerate(notices):
        for offset, piece in pieces(notice):
            owners.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, own in owners.items():
        automaton.add_word(piece, (len(piece), own))
    if owners:
        automaton.make_automaton()
    matchers = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={allowed(n)}}}") for n, _ in notices]
    return automaton if owners else None, matchers


def edited_places(words: list[bytes], notices=NOTICES) -> list[Place]:
    """The places of all notices that stay, in order; code points are not filled in."""
    automaton, matchers = _searcher(tuple(notices))
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    starts: list[int] = []
    found: dict[tuple[int, int, int], Place] = {}
    tried = set()
    for last, (length, own) in automaton.iter(joined) if automaton and joined else ():
        if not starts:
            starts = list(accumulate((len(w.decode("utf-8", "surrogatepass")) + 1 for w in words), initial=0))
        for i, offset in own:
            notice, label = notices[i]
            k = allowed(notice)
            begin = last + 1 - length - offset
            if (i, begin) in tried:
                continue
            tried.add((i, begin))
            low, high = bisect_left(starts, begin - k), bisect_right(starts, begin + k)
            for first in range(low, min(high, len(words))):
                # the word after the run starts one past the run's end
                end = begin + len(notice) + 1
                for after in range(max(first + 1, bisect_left(starts, end - k)), bisect_right(starts, end + k)):
                    size = starts[after] - 1 - starts[first]
                    if (i, first, after) in found or abs(size - len(notice)) > k:
                        continue
                    m = matchers[i].fullmatch(joined, starts[first], starts[after] - 1)
                    if m:
                        found[i, first, after] = Place(label, notice, sum(m.fuzzy_counts), first, after - first)
    kept: list[Place] = []
    taken: list[tuple[int, int]] = []  # word spans of what is kept, disjoint, in order
    for p in sorted(found.values(), key=lambda p: (p.errors, -len(p.notice), p.first_word, p.n_words, p.label)):
        span = (p.first_word, p.first_word + p.n_words)
        at = bisect_left(taken, span)
        if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            taken.insert(at, span)
            kept.append(p)
    return sorted(kept, key=lambda p: p.first_word)


def _with_span(text: str, places: list[Place]) -> list[Place]:
    if not places:
        return places
    spans = [m.span() for m in _IN_WORD.finditer(text)]
    return [p._replace(start=spans[p.first_word][0], end=spans[p.first_word + p.n_words - 1][1]) for p in places]


def scan_text(text: str, notices=NOTICES, base=BASE) -> tuple:
    """The values of ``FIELDS`` for one text."""
    words = words_of(text)
    exact = base_places(b" " + b" ".join(words) + b" ", base)
    places = _with_span(text, edited_places(words, notices))
    base_labels = {label for _, label in exact}
    labels = base_labels | {p.label for p in places}
    score = max([1.0 if exact else 0.0, *(1 - p.errors / len(p.notice) for p in places)])
    at = [w for w, _ in exact]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(labels)), score, [p._asdict() for p in places])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, notices=NOTICES, base=BASE) -> DataFrame:
    """``docs`` with ``FIELDS``: counts and labels of a text and the notices in it, each with
    its edits, words and code points.  ``keep`` names the columns to carry along."""
    def work(texts):
        return [list(c) for c in zip(*(scan_text(t, notices, base) for t in texts))] if texts else [[] for _ in range(8)]

    return with_text_columns(docs, text, work, FIELDS, keep)
