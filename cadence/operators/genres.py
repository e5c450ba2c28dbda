"""Genre analytics over the primary tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import check_tz, local_period, part_of_day, weekday
from cadence.operators.activity import play_counts, with_duration
from cadence.operators.common import akey, in_window, round_half_up_ratio, top_k, utc_plays

# The primary-tag side is one row per tagged artist and is derived, so its size
# is only known at runtime: no static hint.  AQE measures the materialised
# shuffle stage and turns the join into a broadcast join when it is below
# spark.sql.adaptive.autoBroadcastJoinThreshold; otherwise it stays a
# sort-merge join on artist_name (and AQE splits skewed artists).


def _tagged(counts: DataFrame, primary: DataFrame) -> DataFrame:
    """Play counts (``n`` per artist and whatever else) joined to the artist's
    primary tag (exact spelling); untagged plays drop out.  Plays are counted
    before the join, so no raw play is shuffled on a popular artist."""
    return counts.join(primary.select("artist_name", "tag"), "artist_name")


def genre_clock(plays: DataFrame, primary: DataFrame, tz: str = "UTC",
                days: int | None = None, as_of=None) -> DataFrame:
    """A5: plays per (weekday 0=Sunday, part of day, primary tag)."""
    tz = check_tz(tz)
    p = in_window(utc_plays(plays, "artist_name"), days, as_of)
    counts = (p.groupBy("user_id", weekday("listened_at", tz).alias("weekday"),
                        part_of_day("listened_at", tz).alias("part"), "artist_name")
               .agg(F.count(F.lit(1)).alias("n")))
    return (_tagged(counts, primary).groupBy("user_id", "weekday", "part", "tag")
            .agg(F.sum("n").alias("plays")))


def tag_shift(plays: DataFrame, primary: DataFrame, period: str = "month",
              tz: str = "UTC", days: int | None = None, as_of=None) -> DataFrame:
    """Plays per (period, primary tag) and its share of the period's
    tagged plays, rounded half-up to 0.1."""
    tz = check_tz(tz)
    p = in_window(utc_plays(plays, "artist_name"), days, as_of)
    counts = (p.groupBy("user_id", local_period("listened_at", tz, period).alias("period_start"), "artist_name")
               .agg(F.count(F.lit(1)).alias("n")))
    b = _tagged(counts, primary).groupBy("user_id", "period_start", "tag").agg(F.sum("n").alias("plays"))
    total = F.sum("plays").over(Window.partitionBy("user_id", "period_start"))
    return b.withColumn("pct_of_period", round_half_up_ratio(100 * F.col("plays"), total, 1))


def monthly_summary(plays: DataFrame, durations: DataFrame, primary: DataFrame,
                    tz: str = "UTC") -> DataFrame:
    """Per local month plays, new artists, hours and the top primary tag.

    All digests come from one count of plays per (user, month, artist, track):
    hours (J2) and primary tag (J1) are joined to the counts, and the month digests
    are stitched by (user, month) (J7).  An artist's first month is the earliest
    month that has a play of it."""
    counts = play_counts(plays, tz, "month")
    monthly = with_duration(counts, durations).groupBy("user_id", "month").agg(
        F.sum("n").alias("plays"), round_half_up_ratio(F.sum("ms"), F.lit(3_600_000), 1).alias("hours"))
    by_artist = counts.groupBy("user_id", "month", "artist_name").agg(F.sum("n").alias("n"))
    genre = _tagged(by_artist, primary).groupBy("user_id", "month", "tag").agg(F.sum("n").alias("gp"))
    top = (top_k(genre, 1, ["user_id", "month"], [F.desc("gp"), F.asc("tag")])
           .select("user_id", "month", F.col("tag").alias("top_genre")))
    firsts = by_artist.groupBy("user_id", akey().alias("akey")).agg(F.min("month").alias("month"))
    new = firsts.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("new_artists"))
    return (monthly.join(new, ["user_id", "month"], "left")
                   .join(top, ["user_id", "month"], "left")
                   .select("user_id", "month", "plays",
                           F.coalesce("new_artists", F.lit(0)).alias("new_artists"),
                           "hours", "top_genre"))


def genre_tracks(plays: DataFrame, primary: DataFrame, tag: str | None = None,
                 limit: int = 60) -> DataFrame:
    """A10: a user's tracks whose artist's primary tag is ``tag`` (every tag
    when None), plays desc, then track, artist; top ``limit`` per (user, tag)."""
    counts = plays.groupBy("user_id", "artist_name", "track_name").agg(F.count(F.lit(1)).alias("plays"))
    g = _tagged(counts, primary if tag is None else primary.filter(F.col("tag") == tag)).select(
        "user_id", "tag", "artist_name", "track_name", "plays")
    return top_k(g, limit, ["user_id", "tag"],
                 [F.desc("plays"), F.asc("track_name"), F.asc("artist_name")])


def artist_detail_plays(plays: DataFrame) -> DataFrame:
    """A11 (plays): each user's plays per case-folded artist."""
    return (plays.groupBy("user_id", akey().alias("akey"))
                 .agg(F.count(F.lit(1)).alias("plays")))


def artist_detail_tags(clean: DataFrame, limit: int = 8) -> DataFrame:
    """A11 (tags): per folded artist, clean tags by max weight desc, tag; top 8."""
    g = clean.groupBy(akey().alias("akey"), "tag").agg(F.max("weight").alias("weight"))
    return top_k(g, limit, ["akey"], [F.desc("weight"), F.asc("tag")], rank_col="pos")


def artist_detail_tracks(top_tracks: DataFrame, limit: int = 8) -> DataFrame:
    """A11 (tracks): per folded artist, known top tracks by best rank; top 8."""
    g = (top_tracks.filter(F.col("track_name") != "")
                   .groupBy(akey().alias("akey"), "track_name")
                   .agg(F.min("rank").alias("best_rank")))
    return top_k(g, limit, ["akey"], [F.asc("best_rank"), F.asc("track_name")], rank_col="pos")
