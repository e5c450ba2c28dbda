"""Recency-weighted plays as a state that grows by batches.

A play's weight at a time T is 2^-((T - t) / half-life).  Against a fixed landmark L it is
2^((t - L) / half-life) * 2^-((T - L) / half-life): the first factor never changes, the second
is one number for all plays (forward decay).  So a batch is summed once per (user, artist
spelling) against its own landmark, and reading brings every sum to the time asked
for.  A batch's landmark is its newest play, so that sums stay between 0 and the number of
plays, whatever the age of the state.

The state is a table of folders (``sources.folders``), one per batch and a merged one per
``merge``; only the batch's plays are ever read.  Plays must be new (``append_new``); a batch that
is run again under its name changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_ntz, utc_micros
from cadence.operators.common import akey, utc_plays
from cadence.operators.taste import TASTE_HALF_LIFE_DAYS
from cadence.sources.folders import Folders

STATE = "user_id bigint, artist_name string, n bigint, weight double, landmark timestamp_ntz"


def _decay(times: F.Column, landmark: F.Column, half_life_days: float) -> F.Column:
    """2 ** ((times - landmark) / half-life), for times in microseconds."""
    return F.pow(F.lit(2.0), (times - landmark) / F.lit(86_400_000_000.0 * half_life_days))


def summed_plays(plays: DataFrame, half_life_days: float = TASTE_HALF_LIFE_DAYS) -> DataFrame:
    """The state of a batch: plays and weight per (user, spelling) at the batch's newest play."""
    p = utc_plays(plays, "artist_name")
    newest = p.select(F.max("listened_at")).scalar()
    at = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), newest)
    return (p.groupBy("user_id", "artist_name")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(_decay(utc_micros("listened_at"), at, half_life_days)).alias("weight"))
             .withColumn("landmark", newest))


def merged(state: DataFrame, landmark: F.Column | None = None, half_life_days: float = TASTE_HALF_LIFE_DAYS) -> DataFrame:
    """States as one, at ``landmark`` (default: the newest of theirs)."""
    to = state.select(F.max("landmark")).scalar() if landmark is None else landmark
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    factor = _decay(utc_micros("landmark"), F.timestamp_diff("MICROSECOND", epoch, to), half_life_days)
    return (state.groupBy("user_id", "artist_name")
            .agg(F.sum("n").alias("n"), F.sum(F.col("weight") * factor).alias("weight")).withColumn("landmark", to))


class RecencyState:
    def __init__(self, spark: SparkSession, path: str, half_life_days: float = TASTE_HALF_LIFE_DAYS):
        self.folders, self.half_life_days = Folders(spark, path, STATE), half_life_days

    def add(self, plays: DataFrame, batch: str) -> None:
        """Sum a batch of new plays into the state."""
        self.folders.add(summed_plays(plays, self.half_life_days), batch)

    def merge(self) -> None:
        """Put the sums of all batches together; what is read stays the same."""
        self.folders.merge(merged(self.folders.read(), half_life_days=self.half_life_days))

    def scores(self, as_of) -> DataFrame:
        """A13 from the state: (user_id, akey, artist_name, plays, score) at ``as_of``."""
        at = F.lit(as_of_ntz(as_of).isoformat(sep=" ")).cast("timestamp_ntz")
        per = merged(self.folders.read(), at, self.half_life_days)
        best = F.min(F.struct((-F.col("n")).alias("nn"), F.col("artist_name").alias("v")))
        return (per.groupBy("user_id", akey().alias("akey"))
                   .agg(best.alias("_m"), F.sum("n").alias("plays"), F.sum("weight").alias("score"))
                   .select("user_id", "akey", F.col("_m.v").alias("artist_name"), "plays", "score"))
