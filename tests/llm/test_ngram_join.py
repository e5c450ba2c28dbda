import itertools
import random

import numpy as np
import pytest

from cadence.llm import ngram_join as J
from cadence.llm.components import connected
from tests.llm.util import LOWER, docs, prose, words


def shingles(text):
    w = words((text or "").translate(LOWER))
    if len(w) < 4:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(w, w[1:], w[2:], w[3:]))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if a and b and 100 * both >= 85 * (len(a) + len(b) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def corpus():
    rows, k = [], itertools.count(100, -1)
    shared = prose(1, 60)
    for i in range(6):
        base = prose(10 + i, 80)
        rows += [(next(k), base), (next(k), base.upper()), (next(k), base.replace(" ", "\n\t "))]
        rows += [(next(k), edited(base, n, n)) for n in (1, 1, 2, 2, 3, 5)]
        rows.append((next(k), shared + " " + prose(50 + i, 30)))
    chain = prose(90, 100)
    for i in range(8):  # neighbours link, the ends do not
        rows.append((next(k), chain))
        chain = edited(chain, 2, 200 + i)
    rows += [(next(k), t) for t in (None, "", " \n", "one", "One", "one two three", "one two THREE", "a b c d", "a b c e")]
    rows.append((next(k), prose(91, 6000)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("hub_rounds", [0, 2])
def test_components_equal_brute_force(spark, rows, hub_rounds):
    got = J.link_components(docs(spark, rows).repartition(3), hub_rounds=hub_rounds)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_links_equal_brute_force(spark, rows):
    given = rows + rows[:2]  # repeated rows are texts of their own
    members, links = J.join_links(docs(spark, given).repartition(3))
    sets = [shingles(t) for _, t in given]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(given)), 2)
             for both in [len(sets[i] & sets[j])] if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)]
    least = {}
    for (k, _), s in zip(given, sets):
        least[s] = min(least.get(s, k), k)
    n = [sum(i in p for p in pairs) for i in range(len(given))]
    assert max(n) > 5
    assert sorted((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in members.collect()) == sorted(
        (k, len(s), least[s] if s else k, m) for (k, _), s, m in zip(given, sets, n))
    want = {frozenset((least[sets[i]], least[sets[j]])) for i, j in pairs if sets[i] != sets[j]}
    found = [frozenset((r.a_id, r.b_id)) for r in links.collect()]
    assert set(found) == want and len(found) == len(want)
    members, links = J.join_links(docs(spark, given).limit(0))
    assert members.count() == 0 and links.count() == 0


def test_repeated_rows_empty_table_and_extra_columns(spark):
    t = prose(5, 30)
    given = [(7, t), (7, t), (9, t), (4, None), (4, "")]
    df = docs(spark, given).selectExpr("*", "1 AS n", "2 AS id", "3 AS class")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.link_components(df).collect())
    assert got == [(4, 0, 4), (4, 0, 4), (7, 27, 7), (7, 27, 7), (9, 27, 7)]
    assert J.link_components(df.limit(0)).count() == 0


def test_same_id_with_other_texts(spark):
    a, b = prose(1, 40), prose(2, 40)
    got = J.link_components(docs(spark, [(1, a), (1, b), (2, b)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_prefix_is_long_enough():
    for n in range(1, 300):
        need = -(-85 * n // 100)
        assert J.prefix_length(n, 85, 100) == n - need + 1


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_the_driver_gets_a_byte_a_counter_and_some_bitmaps(spark, monkeypatch):
    """Of the corpus the driver holds the rarities and one bitmap of ids, in few rows, and no more."""
    rows = [(i, f"one two three four five six seven eight nine ten w{i // 2} x{i // 2} " + "tail " * (i % 2)) for i in range(600)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got, collect = [], type(given).collect

    def seen(df):
        got.append(collect(df))
        return got[-1]

    monkeypatch.setattr(type(given), "collect", seen)
    rarity = J.frequencies(given, "text")
    assert sum(len(r["counts"]) for r in got[0]) == len(rarity) == 1 << J.SKETCH_BITS
    # 600 documents hold the shingle "one two three four"
    assert rarity.dtype == np.uint8 and rarity.max() >= round(4 * np.log2(600 + 1)) - 1
    got.clear()
    wanted = given.selectExpr("doc_id AS class", "doc_id AS id")
    J._candidate_sets(given, wanted, "text", "doc_id", J.WIDTH)
    assert 0 < len(got[0]) <= 128 and sum(len(r["bits"]) for r in got[0]) <= 1 << 19
