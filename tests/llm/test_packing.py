import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadence.llm import packing as P
from tests.llm.util import SMALL, docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from("aSt' é-_9²İΣ<|endofx>\x85\xa0\x1c\t“"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_word_by_word_equals_the_tokenizer(text):
    w = P.WordIds(PATH)
    assert w.text(text) == w.whole(text)


def check_pieces(tokenizer, rows, given_texts, capacity):
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(given_texts)
    for k, pieces in by_doc.items():
        own = ids(tokenizer, given_texts[k])
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(own)
        for p in pieces:
            part = np.array(own[p.start:p.start + p.length], dtype="<u4").tobytes()
            assert p.start == p.piece * capacity and zlib.crc32(part) == p.ids_crc32
            assert p.length == capacity or p.piece == len(pieces) - 1


def check_sequences(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_query_on_the_small_table(spark, tokenizer):
    from cadence.llm.queries import op7_best_fit_packing
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op7_best_fit_packing(spark, SMALL).collect()
    check_pieces(tokenizer, rows, texts, P.CAPACITY)
    made = check_sequences(rows, P.CAPACITY)
    assert made <= P.lower_bound(np.array([r.length for r in rows])) + 1


def test_edge_cases(spark, tokenizer):
    texts = {1: None, 2: "", 3: "  \n", 4: prose(1, 3000), 5: "<|endoftext|> x", 6: "é" * 5000}
    df = docs(spark, list(texts.items())).selectExpr("*", "9 AS length", "9 AS piece")
    rows = P.pack(P.tokenize(df, PATH, capacity=64), capacity=64).collect()
    check_pieces(tokenizer, rows, texts, 64)
    check_sequences(rows, 64)
    assert P.pack(P.tokenize(df.limit(0), PATH)).count() == 0
    twice = P.pack(P.tokenize(docs(spark, [(1, "a b"), (1, "a b")]), PATH)).collect()
    assert len(twice) == 2 and check_sequences(twice, P.CAPACITY) == 1


@pytest.mark.parametrize("partition_rows", [150, 100_000])
def test_exchange_comes_near_the_bound(spark, partition_rows):
    lengths = np.random.default_rng(5).integers(1, 2048, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = P.pack(df, partition_rows=partition_rows).collect()
    made = check_sequences(rows, P.CAPACITY)
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert made <= P.lower_bound(lengths) * (1.03 if partition_rows == 150 else 1.005)


def fewest(lengths, capacity):
    """Exact packing of a few lengths by search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1:]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 24), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_bound_is_below_the_optimum_and_best_fit_above(lengths):
    a = np.array(sorted(lengths, reverse=True))
    optimum = fewest(a.tolist(), 24)
    sequence, offset = P.best_fit_decreasing(a, 24)
    assert P.lower_bound(a, 24) <= optimum <= sequence.max() + 1
    fill = np.bincount(sequence, a)
    assert fill.max() <= 24
