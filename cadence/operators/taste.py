"""Taste vectors, TF-IDF artist vectors, cosine recommendations and
compatibility (A13, A14, V1-V6).

Sparse vectors are long DataFrames ``(key..., tag, value)``; a dot product is
a join on ``tag`` plus a grouped sum.  Vectors are normalised to unit length
before the join so a cosine is a plain sum, and zero entries (tags whose idf
is 0 because every artist carries them) are dropped before the join: they can
never add to a score but would multiply the join's fan-out.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_ntz, utc_micros
from cadence.operators import bounded_topk
from cadence.operators.common import akey, modal_spelling, top_k, utc_plays
from cadence.plans.session import materialize

# Fixed values (knobs of the reference's recommender)
TASTE_HALF_LIFE_DAYS = 90
SEED_WEIGHT = 0.5
RECOMMEND_TOP_N = 20
BLOCKS = 64  # parts of the artists in which a user's best are found first
SCORE_DIGITS = 9  # scores are rounded before ranking so float summation order can't flip ties


def play_scores(plays: DataFrame, as_of=None, half_life_days: float = TASTE_HALF_LIFE_DAYS) -> DataFrame:
    """Per (user, folded artist) the modal spelling, the play count and
    the recency weight  sum(0.5 ** (age_seconds / (86400 * half_life))).
    Without ``as_of`` the score is the raw play count."""
    p = utc_plays(plays, "artist_name")
    if as_of is None:
        w = F.lit(1.0)
    else:
        delta = as_of_ntz(as_of) - _dt.datetime(1970, 1, 1)
        as_of_us = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
        age_s = (F.lit(as_of_us) - utc_micros("listened_at")) / F.lit(1e6)
        w = F.pow(F.lit(0.5), age_s / F.lit(86400.0 * half_life_days))
    per = (p.groupBy("user_id", akey().alias("akey"), "artist_name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s")))
    return (per.groupBy("user_id", "akey")
               .agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("artist_name").alias("v"))).alias("_m"),
                    F.sum("n").alias("plays"), F.sum("s").alias("score"))
               .select("user_id", "akey", F.col("_m.v").alias("artist_name"), "plays", "score"))


def idf(corpus: DataFrame) -> DataFrame:
    """V1: idf = ln(N / df) per tag; N = artists in the corpus (a scalar
    subquery, evaluated once), df = artists carrying the tag.  The corpus has
    one row per (artist, tag), so df is a plain count."""
    n = corpus.select(F.countDistinct("artist_name")).scalar()
    return (corpus.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
                  .select("tag", F.log(n.cast("double") / F.col("df")).alias("idf")))


def artist_vectors(corpus: DataFrame, idf_df: DataFrame | None = None) -> DataFrame:
    """V2: (artist_name, akey, tag, value) with value = weight / artist total
    weight * idf.  Artists whose total weight is 0 get no vector (they still
    count in N)."""
    idf_df = idf(corpus) if idf_df is None else idf_df
    total = F.sum("weight").over(Window.partitionBy("artist_name"))
    c = corpus.withColumn("_total", total).filter(F.col("_total") > 0)
    return (c.join(idf_df, "tag")
             .select("artist_name", F.lower("artist_name").alias("akey"), "tag",
                     ((F.col("weight") / F.col("_total")) * F.col("idf")).alias("value")))


def scoring_vectors(corpus: DataFrame) -> DataFrame:
    """Artist vectors with both the raw value (for taste vectors) and the
    unit-length value ``unit`` (for cosines), written once to the shared
    checkpoint folder: every user is scored against the same table, so it is
    computed once, like the reference's shared corpus/idf/vector pass."""
    return materialize(scoring_vectors_from(artist_vectors(corpus)), "artist-vectors")


def scoring_vectors_from(vectors: DataFrame) -> DataFrame:
    """Add ``unit``: each artist vector scaled to length 1 (NULL for a zero vector)."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("artist_name")))
    return vectors.withColumn("unit", F.when(norm > 0, F.col("value") / norm))


def unit(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Scale each vector to length 1; zero vectors and zero entries dropped."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys)))
    return (vectors.withColumn("_n", norm)
                   .filter((F.col("_n") > 0) & (F.col("value") != 0))
                   .withColumn("value", F.col("value") / F.col("_n")).drop("_n"))


def taste_vectors(scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """V3: per user sum over played artists of log(1 + score) * artist vector.
    Joined on the folded artist key (deviation: the reference looks the
    vector up by exact spelling); artists without a vector add nothing."""
    s = scores.select("user_id", "akey", "score")
    v = vectors.select("akey", "tag", "value")
    return (s.join(v, "akey")
             .groupBy("user_id", "tag")
             .agg(F.sum(F.log(F.lit(1.0) + F.col("score")) * F.col("value")).alias("value")))


def seed_vectors(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """V6: the taste vector of a user's seeds, each at score 1.0."""
    seeds = (feedback.filter(F.col("verdict") == "seed")
                     .select("user_id", akey().alias("akey"), F.lit(1.0).alias("score"))
                     .distinct())
    return taste_vectors(seeds, vectors)


def exclusions(scores: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """Played, seeded and blocked artists per user, folded."""
    ex = scores.select("user_id", "akey")
    if feedback is not None:
        ex = ex.unionByName(feedback.select("user_id", akey().alias("akey")))
    return ex.distinct()


def recommend(scores: DataFrame, vectors: DataFrame, feedback: DataFrame | None = None,
              k: int = RECOMMEND_TOP_N, seed_weight: float = SEED_WEIGHT, bounds: bool = False) -> DataFrame:
    """V5: the top ``k`` unplayed artists per user by cosine to the taste
    vector, blended half and half with the cosine to the seed vector when
    the user has one.  Scores <= 0 are dropped; played, seeded and blocked
    artists (folded) are removed *before* ranking; users without a taste
    vector get no rows.  Output (user_id, artist_name, score, rank).  With ``bounds``
    users meet only the artists that can be among their best (``bounded_topk``): the
    same rows by fewer products, for corpora with many artists a tag."""
    if "unit" not in vectors.columns:
        vectors = scoring_vectors_from(vectors)
    taste = taste_vectors(scores, vectors)
    au = (vectors.filter(F.col("unit").isNotNull() & (F.col("unit") != 0))
                 .select("artist_name", "akey", "tag", F.col("unit").alias("value")))
    uv = unit(taste, ["user_id"])
    if feedback is not None:
        # cosines are linear in the user's side: blend the two unit vectors tag by
        # tag, once per user, instead of joining each of them to the artists
        seedv = seed_vectors(feedback, vectors)
        users = (taste.select("user_id").distinct()
                      .join(seedv.select("user_id").distinct().withColumn("has_seed", F.lit(True)), "user_id", "left"))
        weight = F.when(F.col("has_seed"), F.when(F.col("kind") == "s", seed_weight).otherwise(1 - seed_weight)).otherwise(1.0)
        both = uv.withColumn("kind", F.lit("t")).unionByName(unit(seedv, ["user_id"]).withColumn("kind", F.lit("s")))
        uv = (both.join(users, "user_id").withColumn("value", weight * F.col("value"))
                  .groupBy("user_id", "tag").agg(F.sum("value").alias("value")))
    excluded = exclusions(scores, feedback)
    ranked = bounded_topk.best(uv, au, excluded, k, SCORE_DIGITS) if bounds else _best(uv, au, excluded, k)
    return ranked.select("user_id", "artist_name", "score", "rank")


def _best(users: DataFrame, artists: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The ``k`` best artists per user by dot product over tags.

    Artists are cut into ``BLOCKS`` blocks.  The join on (tag) is followed by an
    aggregation keyed by (user, block), inside which a user's partial products
    with the block's artists meet in one task; the best ``k`` of a block that are
    not excluded leave it, so the last shuffle holds users x blocks x k rows."""
    a = artists.withColumn("block", F.pmod(F.xxhash64("artist_name"), F.lit(BLOCKS)))
    dots = (users.select("user_id", "tag", F.col("value").alias("_u")).join(a, "tag")
                 .groupBy("user_id", "block", "artist_name", "akey")
                 .agg(F.sum(F.col("_u") * F.col("value")).alias("raw"))
                 .filter("raw > 0"))
    cand = dots.join(excluded, ["user_id", "akey"], "left_anti").withColumn("score", F.round("raw", SCORE_DIGITS))
    order = [F.desc("score"), F.asc("artist_name")]
    best = top_k(cand, k, ["user_id", "block"], order)
    return top_k(best, k, ["user_id"], order, rank_col="rank")


def _pair_artist_plays(plays: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, artist, n) of the users named in the pairs: a semi join on the pairs'
    users comes before the count, so nobody else's plays are aggregated."""
    users = pairs.select(F.explode(F.array("user_a", "user_b")).alias("user_id")).distinct()
    return (plays.select("user_id", "artist_name").join(users, "user_id", "left_semi")
                 .groupBy("user_id", "artist_name").agg(F.count(F.lit(1)).alias("n")))


def _user_tag_plays(counts: DataFrame, primary: DataFrame) -> DataFrame:
    return (counts.join(primary.select("artist_name", "tag"), "artist_name")
                  .groupBy("user_id", "tag").agg(F.sum("n").alias("plays")))


def _pair_sides(pairs: DataFrame, per_user: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(pair_id, key.., a_val, b_val) for the union of both users' keys (U3):
    each side is a join of the pairs with per-user rows, then both are added up per
    key."""
    pu = per_user.select("user_id", *keys, value)
    a = (pairs.select("pair_id", F.col("user_a").alias("user_id"))
              .join(pu, "user_id").select("pair_id", *keys, F.col(value).alias("a_val"), F.lit(0).alias("b_val")))
    b = (pairs.select("pair_id", F.col("user_b").alias("user_id"))
              .join(pu, "user_id").select("pair_id", *keys, F.lit(0).alias("a_val"), F.col(value).alias("b_val")))
    return a.unionByName(b).groupBy("pair_id", *keys).agg(F.sum("a_val").alias("a_val"), F.sum("b_val").alias("b_val"))


def _pct(v: str, total: str):
    """round(100 * v / total, 1), exact half-up on integer counts; a user with
    no tagged plays divides by 1 and gets 0%."""
    den = F.greatest(F.col(total), F.lit(1)).cast("decimal(38,0)")
    return F.round((F.col(v) * 100).cast("decimal(38,0)") / den, 1)


def _compat_tag_sides(plays: DataFrame, primary: DataFrame, pairs: DataFrame):
    sides = _pair_sides(pairs, _user_tag_plays(_pair_artist_plays(plays, pairs), primary), ["tag"], "plays")
    agg = sides.groupBy("pair_id").agg(
        F.sum(F.col("a_val") * F.col("b_val")).cast("double").alias("dot"),
        F.sum(F.col("a_val") * F.col("a_val")).cast("double").alias("na2"),
        F.sum(F.col("b_val") * F.col("b_val")).cast("double").alias("nb2"),
        F.sum("a_val").alias("total_a"), F.sum("b_val").alias("total_b"))
    return sides, agg


def _compat_shared(plays: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, akey, a_plays, b_plays) for folded artists both users play."""
    per_artist = (_pair_artist_plays(plays, pairs).groupBy("user_id", akey().alias("akey"))
                  .agg(F.sum("n").alias("plays")))
    return (_pair_sides(pairs, per_artist, ["akey"], "plays")
            .filter((F.col("a_val") > 0) & (F.col("b_val") > 0))
            .select("pair_id", "akey", F.col("a_val").alias("a_plays"), F.col("b_val").alias("b_plays")))


def compat_score(plays: DataFrame, primary: DataFrame, pairs: DataFrame) -> DataFrame:
    """A14 score: cosine of the two users' primary-tag play-count vectors
    x 100, rounded to 0.1 (half-up; deviation from binary half-even), and the
    number of shared (folded) artists.  A pair of a user with themselves
    compares the user's vector with itself (score 100)."""
    _, agg = _compat_tag_sides(plays, primary, pairs)
    cos = F.when((F.col("na2") > 0) & (F.col("nb2") > 0),
                 F.col("dot") / (F.sqrt("na2") * F.sqrt("nb2"))).otherwise(F.lit(0.0))
    n_shared = _compat_shared(plays, pairs).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("shared_artist_count"))
    return (pairs.select("pair_id", "user_a", "user_b")
            .join(agg.select("pair_id", F.round(cos * 100, 1).alias("score")), "pair_id", "left")
            .join(n_shared, "pair_id", "left")
            .select("pair_id", "user_a", "user_b",
                    F.coalesce("score", F.lit(0.0)).alias("score"),
                    F.coalesce("shared_artist_count", F.lit(0)).cast("long").alias("shared_artist_count")))


def compat_shared_artists(plays: DataFrame, pairs: DataFrame, k: int = 25) -> DataFrame:
    """A14 shared artists: both counts > 0, top 25 per pair by total (ties
    by folded name), shown with the modal spelling over both users' plays
    (each play counted once, also when a pair is one user twice)."""
    shared = _compat_shared(plays, pairs)
    spell = _pair_artist_plays(plays, pairs).withColumn("akey", akey())
    users_of_pair = (pairs.select("pair_id", F.col("user_a").alias("user_id"))
                     .unionByName(pairs.select("pair_id", F.col("user_b").alias("user_id")))
                     .distinct())
    votes = (users_of_pair.join(spell, "user_id")
             .join(shared.select("pair_id", "akey"), ["pair_id", "akey"], "left_semi")
             .groupBy("pair_id", "akey", "artist_name").agg(F.sum("n").alias("n")))
    display = modal_spelling(votes, ["pair_id", "akey"])
    top = top_k(shared.withColumn("total", F.col("a_plays") + F.col("b_plays")),
                k, ["pair_id"], [F.desc("total"), F.asc("akey")])
    return top.join(display, ["pair_id", "akey"]).select("pair_id", "artist_name", "a_plays", "b_plays")


def _compat_tag_rows(plays: DataFrame, primary: DataFrame, pairs: DataFrame) -> DataFrame:
    sides, agg = _compat_tag_sides(plays, primary, pairs)
    rows = (sides.join(agg.select("pair_id", "total_a", "total_b"), "pair_id")
            .select("pair_id", "tag", _pct("a_val", "total_a").alias("a_pct"),
                    _pct("b_val", "total_b").alias("b_pct")))
    return rows.withColumn("gap", F.abs(F.col("a_pct") - F.col("b_pct")))


def _as_double(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "tag", *[F.col(c).cast("double").alias(c) for c in ("a_pct", "b_pct", "gap")])


def compat_shared_tags(plays: DataFrame, primary: DataFrame, pairs: DataFrame, k: int = 15) -> DataFrame:
    """A14 shared tags: each tag's share of the user's tagged plays (exact
    half-up to 0.1; 0 for a user with none), tags with both shares > 0, top
    15 by the sum of shares (ties by tag)."""
    rows = _compat_tag_rows(plays, primary, pairs)
    top = top_k(rows.filter((F.col("a_pct") > 0) & (F.col("b_pct") > 0)), k, ["pair_id"],
                [F.desc(F.col("a_pct") + F.col("b_pct")), F.asc("tag")])
    return _as_double(top)


def compat_divergent_tags(plays: DataFrame, primary: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """A14 divergent tags: the union of both users' tags, top 10 by the gap
    between the two shares (ties by tag)."""
    return _as_double(top_k(_compat_tag_rows(plays, primary, pairs), k, ["pair_id"],
                            [F.desc("gap"), F.asc("tag")]))


def compatibility(plays: DataFrame, primary: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """A14 for a table of user pairs (pair_id, user_a, user_b): the four
    parts of the comparison."""
    return {"score": compat_score(plays, primary, pairs),
            "shared_artists": compat_shared_artists(plays, pairs),
            "shared_tags": compat_shared_tags(plays, primary, pairs),
            "divergent_tags": compat_divergent_tags(plays, primary, pairs)}
