"""Top-k with bounds against the whole product in numpy."""

import numpy as np
import pytest

from cadence.operators import bounded_topk as B


def tables(spark, users, artists, out):
    u = spark.createDataFrame([(i, f"t{j:03d}", float(v)) for i, row in enumerate(users) for j, v in enumerate(row) if v],
                              "user_id long, tag string, value double")
    a = spark.createDataFrame([(f"A{i:04d}", f"a{i:04d}", f"t{j:03d}", float(v)) for i, row in enumerate(artists) for j, v in enumerate(row) if v],
                              "artist_name string, akey string, tag string, value double")
    e = spark.createDataFrame([(int(i), f"a{j:04d}") for i, j in zip(*np.nonzero(out))], "user_id long, akey string")
    return u, a, e


def whole(users, artists, out, k):
    score = np.round(users @ artists.T, 9)
    score[out] = 0
    return {i: [(f"A{j:04d}", row[j]) for j in np.lexsort((np.arange(len(row)), -row)) if row[j] > 0][:k] for i, row in enumerate(score)}


def got(df):
    rows = {}
    for r in sorted(df.collect(), key=lambda r: (r.user_id, r.rank)):
        rows.setdefault(r.user_id, []).append((r.artist_name, r.score))
    return rows


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sparse(rng, n, tags, each):
    x = np.zeros((n, tags))
    for row in x:
        at = rng.choice(tags, size=rng.integers(1, each + 1), replace=False)
        row[at] = rng.integers(1, 9, len(at))
    return x


@pytest.mark.parametrize("kind", ["sparse", "ties", "hot", "negative", "excluded"])
def test_same_rows_as_the_whole_product(spark, kind):
    rng = np.random.default_rng(5)
    users, artists = unit(sparse(rng, 40, 30, 12)), unit(sparse(rng, 150, 30, 6))
    if kind == "ties":  # many artists alike
        artists = unit(np.repeat(sparse(rng, 15, 30, 3) > 0, 10, axis=0).astype(float))
    if kind == "hot":
        users[:, 0], artists[rng.random(150) < 0.9, 0] = 0.7, 0.4
        users, artists = unit(users), unit(artists)
    if kind == "negative":
        artists *= rng.choice([1, 1, -1], artists.shape)
    out = rng.random((40, 150)) < (0.95 if kind == "excluded" else 0.1)
    u, a, e = tables(spark, users, artists, out)
    expected = {i: r for i, r in whole(users, artists, out, 7).items() if r}
    found = got(B.best(u, a, e, 7, 9))
    assert {i: [n for n, _ in r] for i, r in found.items()} == {i: [n for n, _ in r] for i, r in expected.items()}
    assert all(abs(x - y) < 2e-9 for i in found for (_, x), (_, y) in zip(found[i], expected[i]))


def test_hot_tag_and_good_floors_spare_most_products(spark):
    """One tag on every user and on 90 % of the artists; users who like rare tags."""
    rng = np.random.default_rng(9)
    users, artists = sparse(rng, 30, 200, 4), sparse(rng, 2000, 200, 4)
    users[:, 0], artists[rng.random(2000) < 0.9, 0] = 3, 3
    users, artists = unit(users), unit(artists)
    none = np.zeros((30, 2000), dtype=bool)
    u, a, e = tables(spark, users, artists, none)
    order = B.tag_order(a)
    uo, ao = B.ordered_vectors(u, ["user_id"], order), B.ordered_vectors(a, ["artist_name"], order)
    met = B.met_rows(uo, ao, B.floors(u, a, e, 5)).count()
    assert met < 0.1 * ((users > 0).astype(int) @ (artists > 0).astype(int).T).sum()
    assert {i: [n for n, _ in r] for i, r in got(B.best(u, a, e, 5, 9)).items()} == {
        i: [n for n, _ in r] for i, r in whole(users, artists, none, 5).items()}


def test_floors_are_reached(spark):
    rng = np.random.default_rng(1)
    users, artists = unit(sparse(rng, 20, 12, 5)), unit(sparse(rng, 60, 12, 5))
    out = rng.random((20, 60)) < 0.3
    u, a, e = tables(spark, users, artists, out)
    exact = whole(users, artists, out, 4)
    low = {r.user_id: r.floor for r in B.floors(u, a, e, 4).collect()}
    assert len(low) > 10 and all(len(exact[i]) == 4 and f < exact[i][3][1] + 1e-9 for i, f in low.items())


def test_empty_sides(spark):
    u, a, e = tables(spark, np.ones((2, 3)), np.ones((4, 3)), np.zeros((2, 4), dtype=bool))
    assert B.best(u.limit(0), a, e, 3, 9).count() == 0
    assert B.best(u, a.limit(0), e, 3, 9).count() == 0
