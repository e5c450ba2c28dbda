"""License scans against a search over all runs of words with an edit-distance table."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import license_scan as L
from cadence.llm import queries as Q
from tests.llm.util import LOWER, SMALL, docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall((text or "").translate(LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def all_places(words, notices):
    """(errors, -length, first, count, label, notice) of every run near enough to a notice."""
    out = []
    for notice, label in notices:
        k = len(notice) // L.EVERY
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                run = " ".join(words[a:b])
                if len(run) > len(notice) + k:
                    break
                if abs(len(run) - len(notice)) <= k and (d := distance(run, notice)) <= k:
                    out.append((d, -len(notice), a, b - a, label, notice))
    return sorted(out)


def best(words, notices):
    kept = []
    for d, _, a, n, label, notice in all_places(words, notices):
        if all(a + n <= p[3] or p[3] + p[4] <= a for p in kept):
            kept.append((label, notice, d, a, n))
    return sorted(kept, key=lambda p: p[3])


def base(words):
    return sorted((i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())


def mistype(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        text = text[:i] + (rng.choice("aexz -,é7") if kind != 2 else "") + text[i + (kind > 0):]
    return text


@given(st.integers(0, 2 ** 32 - 1))
@settings(max_examples=150, deadline=None)
def test_places_equal_the_search_over_all_runs(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(1, 5)):
        notice = rng.choice(L.NOTICES + L.BASE)[0]
        parts.append(mistype(rng, notice, rng.randint(0, len(notice) // L.EVERY + 1)))
        parts.append(rng.choice(["", " ", "\n", " under the moon ", "license license ", " the MIT "]))
    text = "".join(parts)
    words = lowered(text)
    assert [w.decode() for w in L.words_of(text)] == words
    assert [tuple(p[:5]) for p in L.edited_places(L.words_of(text))] == best(words, L.NOTICES)
    joined = b" " + b" ".join(L.words_of(text)) + b" "
    assert sorted(L.base_places(joined)) == base(words)


@given(st.lists(st.sampled_from(["ab", "abc", "b", "bc", "abcab", "é", "ca"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_short_notices_over_few_letters(words):
    notices = (("ab bc abc ab", "x"), ("bc ab bc ab abc bc abcab", "y"), ("ab", "z"))
    assert [tuple(p[:5]) for p in L.edited_places([w.encode() for w in words], notices)] == best(words, notices)


def test_pieces_cover_a_notice():
    for notice, _ in L.NOTICES:
        assert "".join(p for _, p in L.pieces(notice)) == notice and all(p for _, p in L.pieces(notice))
        assert len(L.pieces(notice)) == L.allowed(notice) + 1


@pytest.mark.parametrize("text, base_labels, labels", [
    ("Released under the MIT License.", "mit", "mit"),
    ("Relased undr the MIT-License", "", "mit"),
    ("under the MIT Licence", "", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2"),
    ("Apache License, Version 1.1", "", "apache-1"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "", "cc-by-sa"),
    ("GNU General Public Licence, and the GNU Lesser General Public License", "", "gpl,lgpl"),
    ("cc by nc, under the mit license; apache license version 2", "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit"),
    ("under the permit licenses", "", ""),
    ("under the moon we read a license plate", "", ""),
    ("", "", ""),
])
def test_labels(text, base_labels, labels):
    got = L.scan_text(text)
    assert (got[4], got[5]) == (base_labels, labels)
    assert (got[6] > 0) == bool(labels) and 0 <= got[6] <= 1


def test_spans_are_code_points_of_the_text(spark):
    text = "é\u00a0x — Permision is hereby granted, free of charge, to ANY person obtaining a copy! cc by nc cc by nc"
    out = L.scan(docs(spark, [(1, text)]), keep=["doc_id"]).first()
    assert [(n.label, n.errors, text[n.start:n.end]) for n in out.notices] == [
        ("mit", 1, "Permision is hereby granted, free of charge, to ANY person obtaining a copy")]
    assert (out.n_base, out.first_word, out.last_word, out.labels, out.score) == (2, 15, 18, "cc-by-nc,mit", 1.0)


def test_odd_rows_and_clashing_columns(spark):
    long = prose(4, 20_000) + " under the mit license " + "under the m " * 20_000
    rows = [(1, None), (2, ""), (3, "\n\t.,"), (None, "Under the MIT license"), (5, long), (2, "")]
    df = docs(spark, rows).selectExpr("*", "'x' AS Labels", "3 AS score")
    got = {(r.doc_id, r.n_words): r for r in L.scan(df).collect()}
    assert L.scan(df).count() == 6
    for key in ((1, 0), (2, 0), (3, 0)):
        assert tuple(got[key][c] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")) == (
            0, None, None, "", "", 0.0, [])
    assert got[None, 4].labels == "mit" and got[5, 80_004].first_word == 20_000
    assert L.scan(df.limit(0)).count() == 0


def test_query_columns_equal_the_words_of_the_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op13_license_scans(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = lowered(texts[r.doc_id])
        places = base(words)
        found = best(words, L.NOTICES) if "licen" in (texts[r.doc_id] or "").lower() else []
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert r.labels == ",".join(sorted({x for _, x in places} | {p[0] for p in found}))
