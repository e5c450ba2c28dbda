"""The plays table on shared storage (S1): written partitioned by UTC play
date so time-range reads prune whole folders, then sorted by user inside the
files so per-user reads skip row groups by min/max statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_ntz
from cadence.operators.common import utc_plays


def write_plays(plays: DataFrame, path: str, mode: str = "append") -> None:
    p = utc_plays(plays, "artist_name", "track_name", "album_name")
    (p.withColumn("play_date", F.to_date("listened_at"))
      .hint("rebalance", "play_date")  # a day's plays together, but large days in several tasks and files
      .sortWithinPartitions("user_id", "listened_at")
      .write.mode(mode).partitionBy("play_date").parquet(path))


def read_plays(spark: SparkSession, path: str, user_id=None, since=None, until=None) -> DataFrame:
    """Plays with optional user and [since, until) filters; the date bounds
    prune partitions, the user filter is pushed to the parquet reader."""
    df = spark.read.parquet(path)
    if since is not None:
        s = as_of_ntz(since)
        df = df.filter((F.col("play_date") >= F.lit(s.date())) &
                       (F.col("listened_at") >= F.lit(s.isoformat(sep=" ")).cast("timestamp_ntz")))
    if until is not None:
        u = as_of_ntz(until)
        df = df.filter((F.col("play_date") <= F.lit(u.date())) &
                       (F.col("listened_at") < F.lit(u.isoformat(sep=" ")).cast("timestamp_ntz")))
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    return df.drop("play_date")
