import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import common as C
from tests.llm.util import LOWER, words

TEXT = st.text(alphabet=st.sampled_from("aAbBé \n\t\x0b\x85 ñÉ1"), max_size=40)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
@settings(max_examples=200, deadline=None)
def test_word_hashes_tell_words_apart(texts):
    seen = {}
    for first, part in C.chunks(texts):
        h, before = C.word_hashes(part)
        for i in range(len(part)):
            expected = [w.translate(LOWER) for w in words(texts[first + i])]
            got = h[before[i]:before[i + 1]].tolist()
            assert len(got) == len(expected)
            for w, x in zip(expected, got):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunks_split_by_size_and_keep_all(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 10)
    texts = ["abcdef", "gh", None, "x" * 50, "", "y"]
    back = [b.decode() for _, part in C.chunks(texts) for b in part]
    assert back == [t or "" for t in texts]
    assert [first for first, _ in C.chunks(texts)] == sorted({f for f, _ in C.chunks(texts)})


def test_ngram_counts_equal_a_count_text_by_text():
    texts = ["abcabc", "", "ab", "xyz abc", "é"]
    cls = np.minimum(np.arange(256), 254).astype(np.uint8)
    together = C.ngram_counts(texts, cls, (2, 3), 256)
    for row, t in zip(together, texts):
        n = len(t.encode())
        assert row.sum() == max(n - 1, 0) + max(n - 2, 0)
        assert (row == C.ngram_counts([t], cls, (2, 3), 256)[0]).all()


def test_sparse_bytes_round_trip():
    x = np.random.default_rng(1).integers(0, 3, (5, 64)).astype(np.float32)
    assert (C.dense_rows(C.sparse_bytes(x), 64) == x).all()


@pytest.mark.parametrize("group", [None, "g"])
def test_bounded_sample_is_bounded_and_stable(spark, group):
    df = spark.range(3000).selectExpr("id AS k", "id % 3 AS g")
    a = C.bounded_sample(df, "k", 20, group)
    got = sorted(map(tuple, a.collect()))
    assert len(got) == (20 if group is None else 60)
    assert got == sorted(map(tuple, C.bounded_sample(df.repartition(7), "k", 20, group).collect()))
    assert C.bounded_sample(df.limit(0), "k", 20, group).count() == 0
    assert C.bounded_sample(df.limit(5), "k", 20, group).count() == 5


def test_with_text_columns_replaces_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9)], "id long, text string, N long")
    out = C.with_text_columns(df, "text", lambda ts: [[len(t) for t in ts]], "n long")
    assert out.columns == ["id", "text", "n"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 3), (2, None, 0)]
    assert C.with_text_columns(df.limit(0), "text", lambda ts: [[len(t) for t in ts]], "n long").count() == 0
