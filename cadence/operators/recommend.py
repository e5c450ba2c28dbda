"""The recommendation cache and song lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cadence.functions.timeops import as_of_lit
from cadence.operators.common import akey, top_k, utc_plays
from cadence.operators.taste import play_scores, recommend, scoring_vectors, taste_vectors
from cadence.plans.session import materialize, read_table
from cadence.schemas import RECOMMENDATIONS
from cadence.sources.folders import Folders

# Fixed values (knobs of the reference's song lists)
FAVORITE_ARTISTS = 15
TRACKS_PER_FAVORITE = 2
GATEWAY_TRACKS = 3
FAVOURITE_SONGS = 25
USER_BUCKETS = 64
# The cache's files with their folders: lists without a row leave no file to tell the schema
_CACHE = StructType([*RECOMMENDATIONS.fields, StructField("buckets", IntegerType()), StructField("user_bucket", IntegerType())])


def refresh(plays: DataFrame, corpus: DataFrame, feedback: DataFrame | None,
            old_cache: DataFrame | None = None, as_of=None, k: int = 20, bounds: bool = False) -> DataFrame:
    """V7: recompute every user's recommendations in one plan.

    Shared work (idf, artist vectors) is planned once for all users.  A user
    without a taste vector keeps the old list; a user with one gets the new list,
    even if it is shorter or empty (every candidate played or blocked)."""
    vectors = scoring_vectors(corpus)
    scores = play_scores(plays, as_of)
    new = recommend(scores, vectors, feedback, k=k, bounds=bounds)
    if old_cache is None:
        return new
    refreshed = taste_vectors(scores, vectors).select("user_id").distinct()
    return new.unionByName(old_cache.select(*new.columns).join(refreshed, "user_id", "left_anti"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def write_cache(recs: DataFrame, path: str, users: DataFrame | None = None, computed_at=None,
                buckets: int = USER_BUCKETS) -> None:
    """Replace the cached lists of ``users`` (default: those in ``recs``).

    Parquet partitioned by user bucket, with dynamic partition overwrite: only the
    buckets of ``users`` are written, with the other users' rows of these buckets
    as they were.  A user whose new list is empty leaves one row without artist,
    so that the bucket is written even if nothing else is in it.  The number of
    buckets is part of the layout and stays that of the first write."""
    spark = recs.sparkSession
    users = (recs if users is None else users).select("user_id").distinct()
    old = read_table(spark, path)
    if old is not None:
        buckets = old.select("buckets").first()[0]
    columns = [f.name for f in RECOMMENDATIONS.fields]
    new = recs.withColumn("computed_at", F.lit(None).cast("timestamp_ntz") if computed_at is None
                          else as_of_lit(computed_at)).select(*columns)
    empty = users.join(recs.select("user_id"), "user_id", "left_anti").select(
        "user_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RECOMMENDATIONS.fields[1:]])
    state = new.unionByName(empty)
    if old is not None:
        touched = users.select(_bucket(buckets).alias("user_bucket")).distinct()
        others = old.join(touched, "user_bucket", "left_semi").join(users, "user_id", "left_anti")
        state = state.unionByName(others.select(*columns))
    state = materialize(state, "cache")  # read before the folders it comes from are replaced
    (state.withColumn("buckets", F.lit(buckets)).withColumn("user_bucket", _bucket(buckets))
          .hint("rebalance", "user_bucket").sortWithinPartitions("user_bucket", "user_id")
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("buckets", "user_bucket").parquet(path))


def read_cache(spark: SparkSession, path: str, user_ids: list[int] | None = None) -> DataFrame:
    """Cached recommendations (best first within a user).  ``user_ids`` prunes
    to the users' buckets and is pushed to the parquet reader."""
    df = spark.read.schema(_CACHE).parquet(path).filter("artist_name IS NOT NULL")
    if user_ids is not None:
        user_ids = [u for u in user_ids if u is not None]  # no list is one of null's
        buckets = df.select("buckets").first()
        wanted = [] if buckets is None else [
            r[0] for r in spark.createDataFrame([(int(u),) for u in user_ids], "user_id long")
            .select(_bucket(buckets[0])).distinct().collect()]  # at most one row for each id asked for
        df = df.filter(F.col("user_bucket").isin(wanted) & F.col("user_id").isin(user_ids))
    return df.select(*[f.name for f in RECOMMENDATIONS.fields])


class PublishedLists:
    """The recommendation lists as versions that appear at once.

    A refresh computes and writes the lists of the users it is asked for, nothing else, as
    one folder that a commit adds to the table (``sources.folders``): a reader finds every
    user's list whole, from before or after the commit.  Of a user with lists in several folders the
    newest counts; an empty list is a row without artist.  ``merge`` leaves the newest."""

    SCHEMA = "user_id bigint, artist_name string, score double, rank int, edition int"

    def __init__(self, spark: SparkSession, path: str):
        self.folders = Folders(spark, path, self.SCHEMA)

    def refresh(self, plays: DataFrame, corpus: DataFrame, feedback: DataFrame | None, as_of=None, k: int = 20,
                users: DataFrame | None = None, bounds: bool = False) -> None:
        """Renew the lists of ``users`` (default: all with plays).  Users without a taste
        vector keep the old list, as in ``refresh``."""
        if users is not None:
            users = materialize(users.select("user_id").distinct(), "renewed-users")
            plays = plays.join(users, "user_id", "left_semi")
            feedback = None if feedback is None else feedback.join(users, "user_id", "left_semi")
        vectors = scoring_vectors(corpus)
        scores = materialize(play_scores(plays, as_of), "play-scores")
        new = recommend(scores, vectors, feedback, k=k, bounds=bounds).select("user_id", "artist_name", "score", "rank")
        new = materialize(new, "new-lists")
        tasted = taste_vectors(scores, vectors).select("user_id").distinct()
        empty = tasted.join(new.select("user_id"), "user_id", "left_anti").select(
            "user_id", F.lit(None).cast("string").alias("artist_name"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("int").alias("rank"))
        self.publish(new.unionByName(empty))

    def publish(self, lists: DataFrame) -> None:
        """Add whole lists (user_id, artist_name, score, rank) of some users."""
        edition = self.folders.version() + 1
        folder = f"lists-{edition}"
        self.folders.write(lists.withColumn("edition", F.lit(edition)), folder)
        self.folders.commit([*self.folders.live(), folder])

    def _newest(self, version: int | None) -> DataFrame:
        rows = self.folders.read(version)
        last = rows.groupBy("user_id").agg(F.max("edition").alias("edition"))
        return rows.join(last, ["user_id", "edition"], "left_semi")

    def read(self, version: int | None = None) -> DataFrame:
        """The lists of a version (default: the newest commit)."""
        return self._newest(version).filter("artist_name IS NOT NULL").drop("edition")

    def merge(self) -> None:
        """Drop the lists that newer ones replaced."""
        self.folders.merge(self._newest(None))


def affected_users(old_vectors: DataFrame, new_vectors: DataFrame, taste: DataFrame) -> DataFrame:
    """(user_id): the users whose list a change of artist vectors can change, besides those whose
    plays or feedback changed: those with a tag in their taste that an artist whose vector
    changed has or had.  ``taste``: (user_id, tag) of all users, from before and after."""
    old, new = (v.select("artist_name", "tag", "value") for v in (old_vectors, new_vectors))
    both = old.withColumnRenamed("value", "_old").join(new.withColumnRenamed("value", "_new"), ["artist_name", "tag"], "full")
    changed = both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("artist_name").distinct()
    tags = both.join(changed, "artist_name", "left_semi").select("tag").distinct()
    return taste.select("user_id", "tag").join(tags, "tag", "left_semi").select("user_id").distinct()


def drop_blocked(recs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Recommendations minus the user's blocked artists (folded)."""
    blocked = (feedback.filter(F.col("verdict") == "block")
                       .select("user_id", akey().alias("akey")))
    return (recs.withColumn("akey", akey())
                .join(blocked, ["user_id", "akey"], "left_anti").drop("akey"))


def favourites(plays: DataFrame, limit: int = FAVORITE_ARTISTS) -> DataFrame:
    """Each user's top artists by plays (exact spelling), ties by name."""
    g = plays.groupBy("user_id", "artist_name").agg(F.count(F.lit(1)).alias("plays"))
    return top_k(g, limit, ["user_id"], [F.desc("plays"), F.asc("artist_name")])


def songs_from_favourites(plays: DataFrame, top_tracks: DataFrame) -> DataFrame:
    """V8: popular tracks of the user's top 15 artists never played by the
    user, at most two per artist, round robin (every artist's best, then
    every artist's second), plays desc within a round; 25 per user."""
    p = utc_plays(plays, "artist_name", "track_name")
    fav = favourites(p)
    tt = top_tracks.filter(F.col("track_name") != "").select("artist_name", "track_name", "rank")
    cand = (tt.join(fav, "artist_name")
              .join(p.select("user_id", "artist_name", "track_name").distinct(),
                    ["user_id", "artist_name", "track_name"], "left_anti"))
    cand = top_k(cand, TRACKS_PER_FAVORITE, ["user_id", "artist_name"],
                 [F.asc("rank"), F.asc("track_name")], rank_col="per_artist")
    out = top_k(cand, FAVOURITE_SONGS, ["user_id"],
                [F.asc("per_artist"), F.desc("plays"), F.asc("artist_name"), F.asc("track_name")],
                rank_col="pos")
    return out.select("user_id", "artist_name", "track_name",
                      F.col("plays").alias("your_artist_plays"), "pos")


def songs_from_new_artists(recs: DataFrame, top_tracks: DataFrame,
                           per_artist: int = GATEWAY_TRACKS) -> DataFrame:
    """V9: the top tracks (rank <= 3) of each recommended artist, ordered by
    recommendation rank then track rank."""
    tt = (top_tracks.filter((F.col("track_name") != "") & (F.col("rank") <= per_artist))
                    .select("artist_name", "track_name", F.col("rank").alias("track_rank")))
    return (recs.select("user_id", "artist_name", F.col("score").alias("artist_score"), "rank")
                .join(tt, "artist_name"))


def bundle(recs: DataFrame, plays: DataFrame, top_tracks: DataFrame,
           feedback: DataFrame) -> dict[str, DataFrame]:
    """What a user's recommendation page shows, as four DataFrames:
    cached artists, songs from favourites, songs from new artists and the
    feedback list."""
    from cadence.operators.worklists import feedback_list
    return {"artists": recs.select("user_id", "artist_name", "score", "rank"),
            "songs_from_favorites": songs_from_favourites(plays, top_tracks),
            "songs_from_new_artists": songs_from_new_artists(recs, top_tracks),
            "feedback": feedback_list(feedback)}
