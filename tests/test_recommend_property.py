"""Recommendations on random small corpora against the definition in matrices: rows are
artists, columns are tags, and every step is one product."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.operators import recommend as R

ARTISTS = [f"a{i}" for i in range(8)]
TAGS = [f"t{i}" for i in range(5)]
PLAYS = "user_id long, artist_name string, track_name string, album_name string, listened_at timestamp_ntz"


def by_matrices(weights: np.ndarray, carried: np.ndarray, counts: np.ndarray, seeds: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The score of every artist; ``out`` marks those that are no candidates.

    ``carried`` says which (artist, tag) cells exist, since a weight may be 0."""
    known = carried.any(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        idf = np.where(carried.any(axis=0), np.log(known.sum() / carried.sum(axis=0)), 0.0)
        vectors = np.nan_to_num(weights / weights.sum(axis=1, keepdims=True)) * idf
    lengths = np.linalg.norm(vectors, axis=1)
    directions = np.divide(vectors, lengths[:, None], out=np.zeros_like(vectors), where=lengths[:, None] > 0)

    def towards(taste):
        size = np.linalg.norm(taste)
        return directions @ taste / size if size > 0 else np.zeros(len(vectors))

    has_vector = weights.sum(axis=1) > 0
    if not (has_vector & (counts > 0)).any():
        return np.zeros(len(vectors))
    score = towards(np.log1p(counts) @ vectors)
    if (has_vector & seeds).any():
        score = (score + towards(np.log(2.0) * seeds @ vectors)) / 2
    return np.where(out, 0.0, score)


_corpus = st.dictionaries(st.sampled_from(ARTISTS), st.dictionaries(st.sampled_from(TAGS), st.integers(0, 100), min_size=1, max_size=4),
                          min_size=2, max_size=8)


@settings(max_examples=5, deadline=None)
@given(_corpus, st.dictionaries(st.sampled_from(ARTISTS), st.integers(1, 5), max_size=4),
       st.lists(st.sampled_from(ARTISTS), max_size=2), st.lists(st.sampled_from(ARTISTS), max_size=2), st.booleans())
def test_recommendations_match_the_matrices(spark, corpus, counts, seeds, blocked, bounds):
    seeds = set(seeds) - set(blocked)
    cells = [(ARTISTS.index(a), TAGS.index(t), w) for a, tags in corpus.items() for t, w in tags.items()]
    weights, carried = np.zeros((8, 5)), np.zeros((8, 5), dtype=bool)
    for i, j, w in cells:
        weights[i, j], carried[i, j] = w, True
    number = np.array([counts.get(a, 0) for a in ARTISTS])
    seeded = np.array([a in seeds for a in ARTISTS])
    out = (number > 0) | seeded | np.array([a in blocked for a in ARTISTS])
    score = np.round(by_matrices(weights, carried, number, seeded, out), 9)
    order = [i for i in np.lexsort((np.arange(8), -score)) if score[i] > 0][:3]

    plays = spark.range(1).selectExpr("1L AS user_id", "'x' AS artist_name", "'x' AS track_name", "'x' AS album_name",
                                      "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS listened_at").limit(0)
    for a, n in counts.items():
        plays = plays.unionByName(spark.range(n).selectExpr("1L AS user_id", f"'{a}' AS artist_name", "CAST(id AS string) AS track_name",
                                                            "CAST(null AS string) AS album_name", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS listened_at"))
    table = spark.createDataFrame([(ARTISTS[i], TAGS[j], w) for i, j, w in cells], "artist_name string, tag string, weight int")
    opinions = spark.createDataFrame([(1, s, "seed", None) for s in seeds] + [(1, b, "block", None) for b in set(blocked)],
                                     "user_id long, artist_name string, verdict string, expanded_at timestamp_ntz")
    got = R.refresh(plays, table, opinions, as_of=None, k=3, bounds=bounds).orderBy("rank").collect()
    assert [r.artist_name for r in got] == [ARTISTS[i] for i in order]
    assert np.allclose([r.score for r in got], score[order], atol=1e-8)
