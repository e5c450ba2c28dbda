"""Enrichment work lists, feedback reads and top artists (K1-K5, F7-F10, A12,
U5).  The incremental lists are anti joins: rows not yet enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_lit
from cadence.operators.common import akey, top_k

# Fixed values
SEED_ARTISTS = 10
RECOMMEND_TOP_N = 20


def missing_durations(plays: DataFrame, durations: DataFrame, user_id=None) -> DataFrame:
    """K1: (artist, track) pairs played but without a stored length."""
    p = plays if user_id is None else plays.filter(F.col("user_id") == user_id)
    pairs = p.select("artist_name", "track_name").distinct()
    return pairs.join(durations.select("artist_name", "track_name"),
                      ["artist_name", "track_name"], "left_anti")


def missing_tags(plays: DataFrame, artist_tags: DataFrame, user_id=None) -> DataFrame:
    """K2: artists played but with no tag row (the '' sentinel counts as asked)."""
    p = plays if user_id is None else plays.filter(F.col("user_id") == user_id)
    return (p.select("artist_name").distinct()
             .join(artist_tags.select("artist_name"), "artist_name", "left_anti"))


def missing_top_tracks(recs: DataFrame, plays: DataFrame, top_tracks: DataFrame,
                       favourites_k: int = 15) -> DataFrame:
    """K3: artists wanted for songs (recommended, or among a user's top 15 by
    plays, exact spelling) with no top-track row yet."""
    g = plays.groupBy("user_id", "artist_name").agg(F.count(F.lit(1)).alias("n"))
    fav = top_k(g, favourites_k, ["user_id"], [F.desc("n"), F.asc("artist_name")]).select("artist_name")
    wanted = recs.select("artist_name").unionByName(fav).distinct()
    return wanted.join(top_tracks.select("artist_name"), "artist_name", "left_anti")


def dedupe_names(names: DataFrame, name_col: str = "name", pos_col: str | None = None,
                 keep: str = "first") -> DataFrame:
    """One name per case-folded key; the spelling at the first (or last)
    position wins.  Without a position any one spelling (the lowest) wins."""
    k = names.withColumn("_k", F.lower(name_col))
    if pos_col is None:
        pick = F.min(name_col)
    elif keep == "first":
        pick = F.min_by(name_col, pos_col)
    else:
        pick = F.max_by(name_col, pos_col)
    return k.groupBy("_k").agg(pick.alias(name_col)).drop("_k")


def unknown_artists(names: DataFrame, artist_tags: DataFrame, plays: DataFrame,
                    name_col: str = "name") -> DataFrame:
    """K4: suggested names neither tagged nor played by anyone (folded)."""
    n = names.withColumn("_k", F.lower(name_col))
    tagged = artist_tags.select(akey().alias("_k")).distinct()
    played = plays.select(akey().alias("_k")).distinct()
    return (n.join(tagged, "_k", "left_anti").join(played, "_k", "left_anti")
             .select(name_col))


def top_artists(plays: DataFrame, feedback: DataFrame | None = None,
                limit: int = SEED_ARTISTS) -> DataFrame:
    """Most-played artists per user, folded with the modal spelling,
    blocked artists skipped; ties by folded name."""
    p = plays.select("user_id", "artist_name", akey().alias("akey"))
    if feedback is not None:
        blocked = (feedback.filter(F.col("verdict") == "block")
                           .select("user_id", akey().alias("akey")))
        p = p.join(blocked, ["user_id", "akey"], "left_anti")
    per = p.groupBy("user_id", "akey", "artist_name").agg(F.count(F.lit(1)).alias("n"))
    g = (per.groupBy("user_id", "akey")
            .agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("artist_name").alias("v"))).alias("_m"),
                 F.sum("n").alias("plays"))
            .select("user_id", "akey", F.col("_m.v").alias("artist_name"), "plays"))
    return top_k(g, limit, ["user_id"], [F.desc("plays"), F.asc("akey")], rank_col="rank") \
        .select("user_id", "artist_name", "plays", "rank")


def pending_seeds(feedback: DataFrame) -> DataFrame:
    """F8: seeds whose similar artists were not looked up yet."""
    return (feedback.filter((F.col("verdict") == "seed") & F.col("expanded_at").isNull())
                    .select("user_id", "artist_name"))


def feedback_names(feedback: DataFrame, verdict: str) -> DataFrame:
    """names with one verdict."""
    return feedback.filter(F.col("verdict") == verdict).select("user_id", "artist_name")


def feedback_list(feedback: DataFrame) -> DataFrame:
    """every opinion of a user, ordered by verdict then folded name
    (``pos`` carries the order)."""
    w = Window.partitionBy("user_id").orderBy("verdict", F.lower("artist_name"), "artist_name")
    return feedback.select("user_id", "artist_name", "verdict").withColumn("pos", F.row_number().over(w))


def seeds_to_expand(users: DataFrame, feedback: DataFrame, recs: DataFrame, plays: DataFrame,
                    top_n: int = RECOMMEND_TOP_N, seed_artists: int = SEED_ARTISTS) -> DataFrame:
    """K5: for users with pending seeds or fewer than ``top_n`` cached
    recommendations, the names to look up: pending seeds then top artists,
    one per folded name, the later spelling winning (as a dict keyed on the
    folded name keeps the last value)."""
    pend = pending_seeds(feedback)
    n_recs = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_recs"))
    has_pending = pend.select("user_id").distinct().withColumn("pending", F.lit(True))
    need = (users.select("user_id").distinct()
                 .join(n_recs, "user_id", "left").join(has_pending, "user_id", "left")
                 .filter(F.col("pending").isNotNull() | (F.coalesce("n_recs", F.lit(0)) < top_n))
                 .select("user_id"))
    top = top_artists(plays, feedback, seed_artists)
    names = (pend.select("user_id", "artist_name", F.lit(0).alias("src"), F.lit(0).alias("r"))
             .unionByName(top.select("user_id", "artist_name", F.lit(1).alias("src"),
                                     F.col("rank").alias("r"))))
    names = names.join(need, "user_id", "left_semi")
    pick = F.max_by("artist_name", F.struct("src", "r"))
    return (names.groupBy("user_id", akey().alias("akey")).agg(pick.alias("artist_name"))
                 .select("user_id", "artist_name"))


def stale_users(users: DataFrame, as_of, max_age_days: int = 1) -> DataFrame:
    """users never synced or synced more than a day before ``as_of``."""
    limit = as_of_lit(as_of) - F.make_dt_interval(days=F.lit(max_age_days))
    return users.filter(F.col("last_synced_at").isNull() | (F.col("last_synced_at") < limit)) \
                .select("user_id", "last_synced_at")
