"""Language ID, quality classifier and quality rules."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import language_id as L
from cadence.llm import quality_knn as K
from cadence.llm import quality_rules as R
from tests.llm.util import SMALL, crc, docs, prose, words

STEMS = {"en": ("the", "thing", "other", "with", "where", "ly"), "de": ("und", "schei", "ung", "keit", "über", "ein"),
         "fr": ("que", "eau", "été", "oui", "être", "ment")}


def texts(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def language_rows():
    return [(i * 10 + j, t, lang) for j, lang in enumerate(STEMS) for i, t in enumerate(texts(lang, 60, j))]


def test_language_held_out_and_edge_cases(spark, language_rows):
    odd = [(9001, None, "en"), (9002, "", None), (9003, "123 !?", "en"), (9004, "und ein scheikeit", None), (None, "the other", "en"),
           (9005, "x" * 200_000, None), (9006, "日本語 テキスト", None)]
    df = docs(spark, language_rows + odd + language_rows[:1])
    from pyspark.sql import functions as F
    out = L.identify(df.withColumn("score", F.lit("clash")), L.fit(df.filter(~L.held_out(F.col("doc_id")))), keep=["doc_id", "score"])
    rows = out.collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert len(rows) == len(language_rows) + len(odd) + 1
    right = [got[k][0].lang_pred == lang for k, _, lang in language_rows if crc(k, 4) == 2]
    assert len(right) > 20 and np.mean(right) > 0.98
    assert not any(got[k][0].rejected for k, _, _ in language_rows)
    for k in (9001, 9002, 9003):
        assert (got[k][0].lang_pred, got[k][0].score, got[k][0].rejected) == ("und", 0.0, True)
    assert got[9004][0].lang_pred == "de"
    assert got[9006][0].lang_pred in STEMS and got[9006][0].rejected
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in got[language_rows[0][0]]}) == 1


def test_language_without_training_rows(spark):
    df = docs(spark, [(1, "the other thing", None)])
    model = L.fit(df)
    assert [tuple(r) for r in L.identify(df, model, keep=["doc_id"]).collect()] == [(1, "und", 0.0, True)]
    assert L.identify(df.limit(0), model, keep=["doc_id"]).count() == 0


def test_language_prediction_is_the_nearest_centroid():
    model = L.fit_counts([lang for lang in STEMS for _ in range(40)],
                         L.ngram_counts([t for i, lang in enumerate(STEMS) for t in texts(lang, 40, i)], L._CLASS, L.SIZES, L.DIMS))
    for t in texts("fr", 5, 99) + texts("de", 5, 98):
        v = L.vectors(L.ngram_counts([t], L._CLASS, L.SIZES, L.DIMS), model.idf)[0]
        cosines = [float(np.dot(v, c)) for c in model.centroids]
        lang, score, _ = L.predict(model, [t])
        assert lang == [model.languages[int(np.argmax(cosines))]] and abs(score[0] - max(cosines)) < 1e-5


def quality_rows():
    rng = random.Random(4)
    good = [(i, prose(i, rng.randint(30, 120)) + ".", 1) for i in range(120)]
    bad = []
    for i in range(120):
        w = prose(500 + i, 20).split()
        bad.append((1000 + i, " ".join(x for x in w for _ in range(8)) if i % 2 else " ".join(x.upper() + "!!" for x in w * 3), 0))
    return good + bad


def labels(spark, rows):
    return spark.createDataFrame([(k, q, 0) for k, _, q in rows] + [(1, None, None), (None, 1, 0), (77777, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def test_quality_classifier_held_out(spark):
    from pyspark.sql import functions as F
    rows = quality_rows()
    df = docs(spark, [r[:2] for r in rows] + [(5001, None), (5002, ""), (5003, "a" * 100_000)] + [rows[0][:2]])
    lab = labels(spark, rows)
    model = K.fit(df, lab.filter(~K.held_out(F.col("doc_id"))), per_label=60)
    assert 118 <= len(model.labels) <= 120  # a sampled label may have no document
    out = K.classify(df.withColumn("predicted", F.lit("clash")), model, keep=["doc_id", "predicted"]).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + 4
    right = [got[k].predicted == q for k, _, q in rows if crc(k, 3) == 1]
    assert len(right) > 40 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    train = [q for k, _, q in rows if crc(k, 3) != 1] + [1]  # label row 77777 has no document but counts
    assert got[5001].score == got[5002].score and abs(got[5001].score - np.mean(train)) < 0.02


def test_quality_classifier_votes_as_brute_force():
    rows = quality_rows()
    model = K.fit_counts(K.term_counts([t for _, t, _ in rows]), np.array([q for _, _, q in rows]))
    for t in (rows[3][1], rows[150][1], prose(77, 25)):
        v = model.latent(K.term_counts([t]))[0].astype(float)
        cosine = model.vectors.astype(float) @ v
        near = np.argsort(-cosine, kind="stable")[:15]
        w = np.clip(cosine[near], 0, 1) ** 4
        assert abs(K.score(model, [t])[0] - (w * model.labels[near]).sum() / w.sum()) < 1e-3


def test_quality_classifier_without_labels(spark):
    df = docs(spark, [(1, "some text"), (2, None)])
    model = K.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted(tuple(r) for r in K.classify(df, model, keep=["doc_id"]).collect()) == [(1, 0.5, 1), (2, 0.5, 1)]
    assert K.classify(df.limit(0), model, keep=["doc_id"]).count() == 0


def brute_base(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    marked = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(c - 1 for c in Counter(lines).values())
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)]


@given(st.text(alphabet=st.sampled_from("ab \n#|é\x0b"), max_size=120))
@settings(max_examples=300, deadline=None)
def test_base_statistics_equal_brute_force(text):
    assert R.statistics(text)[0] == brute_base(text)


def test_quality_rules_on_the_small_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    trees = R.fit(d, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts_ = {r.doc_id: r.text for r in d.collect()}
    for r in R.judge(d, trees, keep=["doc_id"]).collect():
        base = brute_base(texts_[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r.kept == (not r.base_failed and r.quality_score >= 0.5)


def test_quality_rules_learn_and_handle_edge_cases(spark):
    from pyspark.sql import functions as F
    rows = quality_rows()
    df = docs(spark, [r[:2] for r in rows] + [(5001, None), (5002, ""), (5003, "w " * 50_000), rows[0][:2]])
    trees = R.fit(df, labels(spark, rows))
    out = R.judge(df.withColumn("kept", F.lit(1)).withColumn("N_WORDS", F.lit(1)), trees, keep=["doc_id", "kept", "N_WORDS"])
    assert [c.lower() for c in out.columns].count("kept") == 1
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[k].kept == bool(q) for k, _, q in rows)
    assert (got[5001].n_words, got[5001].base_failed, got[5001].kept) == (0, True, False)
    assert got[5003].n_repeat_words == 50_000 and not got[5003].kept
    none = R.fit(df, labels(spark, []).limit(0))
    assert all(r.kept != r.base_failed for r in R.judge(df, none, keep=["doc_id"]).collect())
    assert R.judge(df.limit(0), trees).count() == 0


def test_trees_keep_their_constraints_and_match_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((800, 4))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.1 * rng.standard_normal(800) > 0).astype(float)
    signs = np.array([1, -1, 0, 0])
    m = R.fit_trees(x, y, signs)
    p = m.probability(x)
    assert np.mean((p >= 0.5) == y) > 0.9
    for f in (0, 1):
        for step in (0.01, 0.1, 0.5):
            z = x.copy()
            z[:, f] += step
            assert (signs[f] * (m.probability(z) - p) >= -1e-12).all()
    for row, prob in list(zip(x, p))[:50]:
        odds = m.start
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            odds += leaf[node - len(f)]
        assert abs(prob - 1 / (1 + np.exp(-odds))) < 1e-12
