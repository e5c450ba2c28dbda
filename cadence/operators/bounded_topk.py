"""Exact top-k by dot product over sparse vectors, with norm bounds (V5).

Users and artists are long tables (key, tag, value).  Joining them on the tag meets
every user with every artist on every tag they share.  Here a pair is met only on
tags where it can still be among the user's best:

* Tags have one order, rare first.  A vector's *rest* at a tag is the length of what
  it holds from that tag on.  By Cauchy-Schwarz two vectors whose first common tag is t
  have a dot product of at most rest_u(t) * rest_a(t).  So a pair that reaches a score s
  is met on a tag where that product is at least s, and both rests only shrink along
  the order: the rows of a pair that are needed are a first part of its common tags.
* A score that the user's k-th best surely reaches comes from a few artists: the best
  ones of the user's strongest tags (``CHAMPIONS`` a tag), less the excluded ones, are
  scored in full; the k-th best of them is the user's floor.  With fewer than k of
  them the floor is 0, and all common tags are met.
* What a pair has summed over its first part plus the rests after it bounds its score.
  Pairs that stay, less the excluded ones, get the rest of their sum by looking up their
  own further tags, and the k best by (score, name) are ranked.

A tag that nearly every artist carries comes last in the order, where the rests are
small, so its rows are hardly met.  Floors are lowered by ``SLACK`` against rounding, so
ties at the k-th place are all kept and results equal those of the plain product.
Negative values are allowed: the bounds are norms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.common import top_k
from cadence.plans.session import materialize

#: Best artists of a tag from which floors are taken, and strongest tags of a user.
CHAMPIONS, STRONGEST = 64, 2
#: A floor is lowered by this much; scores are compared after rounding to 9 digits.
SLACK = 1e-8


def ordered_vectors(vectors: DataFrame, keys: list[str], order: DataFrame) -> DataFrame:
    """``vectors`` (keys, tag, value) with the tag's place and the squared length ``rest2`` of the
    vector from that tag on.  A window holds one vector."""
    w = Window.partitionBy(*keys).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return vectors.join(order, "tag").withColumn("rest2", F.sum(F.col("value") * F.col("value")).over(w))


def tag_order(artists: DataFrame) -> DataFrame:
    """(tag, place): a sortable place, rare tags first."""
    counts = artists.groupBy("tag").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("tag", F.struct("_n", F.col("tag").alias("_t")).alias("place"))


def _length(square: Column) -> Column:
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def floors(users: DataFrame, artists: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """(user_id, floor): a score that the k-th best artist of the user reaches; users for
    whom fewer than k artists are scored here have no row."""
    champions = top_k(artists.select("tag", "artist_name", "akey", F.col("value").alias("_a")), CHAMPIONS, ["tag"],
                      [F.desc("_a"), F.asc("artist_name")])
    strongest = top_k(users.select("user_id", "tag", F.col("value").alias("_u")), STRONGEST, ["user_id"], [F.desc("_u"), F.asc("tag")])
    first = (strongest.join(champions, "tag").groupBy("user_id", "artist_name", "akey").agg(F.sum(F.col("_u") * F.col("_a")).alias("_s"))
             .join(excluded, ["user_id", "akey"], "left_anti"))
    some = top_k(first, k + 3, ["user_id"], [F.desc("_s"), F.asc("artist_name")]).select("user_id", "artist_name")
    scored = (some.join(artists.select("artist_name", "tag", F.col("value").alias("_a")), "artist_name")
              .join(users.select("user_id", "tag", F.col("value").alias("_u")), ["user_id", "tag"])
              .groupBy("user_id", "artist_name").agg(F.sum(F.col("_u") * F.col("_a")).alias("score")))
    ranked = top_k(scored.filter("score > 0"), k, ["user_id"], [F.desc("score"), F.asc("artist_name")], rank_col="rank")
    return ranked.filter(F.col("rank") == k).select("user_id", (F.col("score") - SLACK).alias("floor"))


def met_rows(users: DataFrame, artists: DataFrame, floor: DataFrame) -> DataFrame:
    """The (user, artist, tag) rows that are multiplied: those of common tags on which the
    product of both rests reaches the user's floor."""
    u = users.join(floor, "user_id", "left").select(
        "user_id", "tag", "place", F.col("value").alias("_u"), F.col("rest2").alias("_ur"),
        F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(0.0)).alias("floor"))
    a = artists.select("artist_name", "akey", "tag", F.col("value").alias("_a"), F.col("rest2").alias("_ar"))
    return u.join(a, "tag").filter(F.col("_ur") * F.col("_ar") >= F.col("floor") * F.col("floor"))


def best(users: DataFrame, artists: DataFrame, excluded: DataFrame, k: int, digits: int) -> DataFrame:
    """(user_id, artist_name, score, rank): the k best artists of every user.

    ``users``: (user_id, tag, value); ``artists``: (artist_name, akey, tag, value);
    ``excluded``: (user_id, akey).  Scores are rounded to ``digits`` and must be above 0."""
    order = tag_order(artists)
    users = materialize(ordered_vectors(users, ["user_id"], order), "user-vectors")
    artists = materialize(ordered_vectors(artists, ["artist_name"], order), "artist-rests")
    met = met_rows(users, artists, floors(users, artists, excluded, k))
    after = (_length(F.col("_ur") - F.col("_u") * F.col("_u")) * _length(F.col("_ar") - F.col("_a") * F.col("_a")))
    pairs = (met.groupBy("user_id", "artist_name", "akey")
             .agg(F.sum(F.col("_u") * F.col("_a")).alias("first"), F.min(after).alias("more"), F.max("place").alias("last"),
                  F.first("floor").alias("floor"))
             .filter(F.col("first") + F.col("more") >= F.col("floor"))
             .join(excluded, ["user_id", "akey"], "left_anti"))
    further = artists.select("artist_name", "tag", "place", F.col("value").alias("_a"))
    rest = (pairs.select("user_id", "artist_name", "last").join(further, "artist_name").filter("place > last")
            .join(users.select("user_id", "tag", F.col("value").alias("_u")), ["user_id", "tag"])
            .groupBy("user_id", "artist_name").agg(F.sum(F.col("_u") * F.col("_a")).alias("rest")))
    scored = (pairs.join(rest, ["user_id", "artist_name"], "left")
              .withColumn("raw", F.col("first") + F.coalesce("rest", F.lit(0.0))).filter("raw > 0")
              .select("user_id", "artist_name", F.round("raw", digits).alias("score")))
    return top_k(scored, k, ["user_id"], [F.desc("score"), F.asc("artist_name")], rank_col="rank")
