"""Merkle manifest against a plain walk over lists."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import merkle as M
from cadence.llm import queries as Q
from tests.llm.util import DOCS, SMALL, crc


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, follow):
    """(top, siblings level by level, index of the walked node at each level)."""
    seen = []
    while len(nodes) > 1:
        low = follow // 3 * 3
        run = nodes[low:low + 3]
        seen.append((run[:follow - low], run[follow - low + 1:]))
        nodes, follow = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], follow // 3
    return nodes[0], seen


def twin(rows, altered):
    """Output rows of the whole table, built source by source."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climb([leaf_of(r) for r in sources[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        leaves = [leaf_of(r) for r in sources[s]]
        root, outer = climb(subroots, k)
        for i, r in enumerate(sources[s]):
            way = climb(leaves, i)[1] + outer
            node = leaf_of(altered(r))
            for left, right in way:
                node = h(*left, node, *right)
            out.append((r[0], leaves[i], subroots[k], root, h(*(d for left, right in way for d in left + right)), node, node == root))
    return out


def cut(row):
    if row[0] is None or row[1] is None or crc(row[0], 2):
        return row
    return (row[0], row[1].replace("\n", ""), *row[2:])


def altered_text():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(rows, altered=cut):
    return sorted(twin(rows, altered), key=repr)


def some_rows(n, sources, seed):
    rng = random.Random(seed)
    return [(rng.randrange(10 ** 9), rng.choice(["a\nb", "é\n", "plain", "", None]), rng.choice(["en", None]),
             rng.choice(sources), rng.choice([None, 5])) for _ in range(n)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_tree_proofs_and_folds(spark, height):
    hot = [(i, f"text\n{i}", "en", "hot", 6) for i in range(100, 161)]
    rows = hot + some_rows(30, ["a", "ä", "Z", "b", None], 1) + [(None, "x\n", None, "a", 1), (None, None, None, None, None)]
    rows += [(7, "one\n", "en", "lone", 4)] + [(3, "same\n", "en", "b", 5)] * 2 + [(3, "other", "en", "b", 5)]
    df = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit("clash")).withColumn("leaf", F.lit(1)).repartition(6)
    assert result(M.manifest(df, altered_text(), height=height)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a\nb", "en", "s", 3)], [(1, None, None, None, None)], [(i, "a", "en", str(i), 1) for i in range(11)]])
def test_small_tables(spark, rows):
    assert result(M.manifest(spark.createDataFrame(rows, DOCS), altered_text(), height=1)) == expected(rows)


def test_untampered_rows_verify(spark):
    rows = some_rows(40, ["a", "b"], 2)
    got = M.manifest(spark.createDataFrame(rows, DOCS))
    assert got.filter("NOT verified").count() == 0
    assert result(got) == expected(rows, altered=lambda r: r)


def test_query_on_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert result(Q.op12_merkle_manifest(spark, SMALL)) == expected(rows)


def test_places_over_many_parts(spark):
    df = spark.range(500).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 7 AS string)) AS g", "id % 50 AS k", "id").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.placed(df, "g", ["k", "id"], "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r["k"], r["id"]))
        assert [r["place"] for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}


@given(st.integers(1, 90), st.data())
@settings(max_examples=60, deadline=None)
def test_paths_fold_to_the_top(n, data):
    leaves = [h(str(i)) for i in range(n)]
    i = data.draw(st.integers(0, n - 1))
    levels = M._reduced(leaves, M._levels(n))
    path = M._path(levels, i)
    top, way = climb(leaves, i)
    assert levels[-1] == [top] and M.fold(leaves[i], path) == top
    assert M.proof(path) == "".join(d for left, right in way for d in left + right)
    assert M.fold(h("other"), path) != top
