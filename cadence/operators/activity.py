"""Listening activity: streaks, discovery, loyalty, clock, hours, reports (A1-A4,
A7, A8, A20, F1).  All users in one plan; ``user_id`` leads every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import (
    as_of_ntz,
    check_tz,
    local_date,
    local_period,
    part_of_day,
)
from cadence.operators.common import akey, in_window, modal_spelling, round_half_up_ratio, utc_plays


def streaks(plays: DataFrame, tz: str = "UTC", as_of=None) -> DataFrame:
    """A1: runs of consecutive local days with at least one play.

    Gaps and islands: ``day - row_number`` is constant along a run.  The
    distinct (user, day) set is small (bounded by calendar days per user), so
    the per-user window is cheap even for the heaviest listener.  With
    ``as_of`` a flag ``is_current`` marks the run ending on as_of's local day or
    the day before (our rule; the reference leaves it to its web page).
    """
    tz = check_tz(tz)
    days = (utc_plays(plays)
            .select("user_id", local_date("listened_at", tz).alias("play_day"))
            .distinct())
    w = Window.partitionBy("user_id").orderBy("play_day")
    grouped = days.withColumn("streak_id", F.date_sub("play_day", F.row_number().over(w)))
    out = grouped.groupBy("user_id", "streak_id").agg(
        F.min("play_day").alias("start_day"),
        F.max("play_day").alias("end_day"),
        F.count(F.lit(1)).alias("length_days"),
    ).drop("streak_id")
    if as_of is not None:
        today = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz),
                                             F.lit(as_of_ntz(as_of).isoformat(sep=" ")).cast("timestamp_ntz")))
        out = out.withColumn("is_current", F.col("end_day") >= F.date_sub(today, 1))
    return out


def _firsts(plays: DataFrame) -> DataFrame:
    return (utc_plays(plays, "artist_name")
            .groupBy("user_id", akey().alias("akey"))
            .agg(F.min("listened_at").alias("first_play")))


def discovery(plays: DataFrame, tz: str = "UTC") -> DataFrame:
    """A2: artists (case-folded) counted in the local month of their first play."""
    tz = check_tz(tz)
    return (_firsts(plays)
            .groupBy("user_id", local_period("first_play", tz, "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("new_artists")))


def loyalty(plays: DataFrame, tz: str = "UTC", days: int | None = None, as_of=None,
            min_plays: int = 5) -> DataFrame:
    """A3: active_days / days from first play to the user's latest play.

    The anchor is the user's latest local play day inside the window (J20),
    an aggregate per user joined back to the per-artist rows.
    Artists are folded on lower(); the shown spelling is the modal one, ties
    to the lowest.
    """
    tz = check_tz(tz)
    p = in_window(utc_plays(plays, "artist_name"), days, as_of)
    # one pre-aggregate (user, artist key, spelling, local day) feeds both the
    # day statistics and the modal spelling; it is far smaller than plays
    per_day = (p.groupBy("user_id", akey().alias("akey"), "artist_name",
                         local_date("listened_at", tz).alias("play_day"))
                .agg(F.count(F.lit(1)).alias("n")))
    days_ = (per_day.groupBy("user_id", "akey", "play_day").agg(F.sum("n").alias("n"))
                    .groupBy("user_id", "akey").agg(
                        F.sum("n").alias("plays"),
                        F.count(F.lit(1)).alias("active_days"),
                        F.min("play_day").alias("first_day"),
                        F.max("play_day").alias("last_day")))
    spelling = modal_spelling(per_day.groupBy("user_id", "akey", "artist_name").agg(F.sum("n").alias("n")),
                              ["user_id", "akey"])
    per = days_.join(spelling, ["user_id", "akey"])
    # the user's latest day as an aggregate joined back (not a window over all
    # of a user's artists): a hot user's rows can then be split by AQE
    latest = days_.groupBy("user_id").agg(F.max("last_day").alias("latest"))
    per = per.join(latest, "user_id").withColumn(
        "days_since_first_play", (F.datediff(F.col("latest"), F.col("first_day")) + 1).cast("long"))
    return (per.filter(F.col("plays") >= min_plays)
            .select("user_id", "artist_name", "plays", "active_days", "days_since_first_play",
                    round_half_up_ratio(F.col("active_days"), F.col("days_since_first_play"), 2)
                    .alias("loyalty")))


def clock(plays: DataFrame, tz: str = "UTC", days: int | None = 365, as_of=None) -> DataFrame:
    """A4: plays per (local day, part of day); empty cells are absent."""
    tz = check_tz(tz)
    p = in_window(utc_plays(plays), days, as_of)
    return (p.groupBy("user_id", local_date("listened_at", tz).alias("day"),
                      part_of_day("listened_at", tz).alias("part"))
             .agg(F.count(F.lit(1)).alias("plays")))


def _hours(ms_sum):
    return round_half_up_ratio(ms_sum, F.lit(3_600_000), 1)


def listening_time(plays: DataFrame, durations: DataFrame, period: str = "month",
                   tz: str = "UTC") -> DataFrame:
    """Plays and hours per local week/month; unknown lengths add 0 hours."""
    return (with_duration(play_counts(plays, tz, period), durations).groupBy("user_id", "month")
            .agg(F.sum("n").alias("plays"), _hours(F.sum("ms")).alias("hours")))


def play_counts(plays: DataFrame, tz: str = "UTC", period: str = "month") -> DataFrame:
    """(user, month, artist, track, n): plays counted before any join, so a popular
    artist or track reaches the join as one row per user and period."""
    p = utc_plays(plays, "artist_name", "track_name")
    return (p.groupBy("user_id", local_period("listened_at", check_tz(tz), period).alias("month"),
                      "artist_name", "track_name").agg(F.count(F.lit(1)).alias("n")))


def with_duration(counts: DataFrame, durations: DataFrame) -> DataFrame:
    """Counts left-joined to track lengths on exact (artist, track); ``ms`` is the
    length times the count, 0 for an unknown length."""
    d = durations.select("artist_name", "track_name", "duration_ms")
    return (counts.join(d, ["artist_name", "track_name"], "left")
                  .withColumn("ms", F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)) * F.col("n"))
                  .drop("duration_ms"))


def report(plays: DataFrame, period: str = "month", tz: str = "UTC") -> DataFrame:
    """Per period plays, distinct track names, distinct folded artists and
    the change against the previous period that has plays (LAG)."""
    tz = check_tz(tz)
    p = utc_plays(plays, "artist_name", "track_name")
    m = p.groupBy("user_id", local_period("listened_at", tz, period).alias("month")).agg(
        F.count(F.lit(1)).alias("plays"),
        F.countDistinct("track_name").alias("distinct_tracks"),
        F.countDistinct(akey()).alias("distinct_artists"),
    )
    w = Window.partitionBy("user_id").orderBy("month")
    return m.withColumn("plays_vs_prev_month", F.col("plays") - F.lag("plays").over(w))


def landed_counts(plays: DataFrame) -> DataFrame:
    """Plays stored per user."""
    return plays.groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"))


def recent_plays(plays: DataFrame, days: int, as_of) -> DataFrame:
    """plays with ``listened_at >= as_of - days`` (no upper bound)."""
    p = utc_plays(plays, "artist_name", "track_name", "album_name")
    return in_window(p, days, as_of)

