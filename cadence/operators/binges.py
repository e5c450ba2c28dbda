"""Binges (W2, W9, W10): the peak count of plays in any trailing 7 days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import utc_micros
from cadence.operators.common import in_window, top_k, utc_plays
from cadence.plans.session import materialize

WEEK_US = 7 * 86_400 * 1_000_000


def peak_7d(p: DataFrame, keys: list[str]) -> DataFrame:
    """Max over plays of ``COUNT(*) OVER (PARTITION BY keys ORDER BY t RANGE
    BETWEEN 7 DAYS PRECEDING AND CURRENT ROW)`` (both ends and peers included).

    Exact and skew-proof: time is cut into 7-day chunks and every play is also
    copied, flagged as context, into the next chunk.  Any 7-day lookback from a
    play in chunk c only reaches chunk c-1, so each window partition
    (keys, chunk) holds at most two weeks of one group, however hot the group.
    Counts are kept only for a chunk's own plays.
    """
    us = utc_micros("listened_at")
    chunk = F.floor(us / F.lit(WEEK_US))
    copies = F.array(F.struct(chunk.alias("c"), F.lit(False).alias("ctx")),
                     F.struct((chunk + 1).alias("c"), F.lit(True).alias("ctx")))
    x = (p.select(*keys, us.alias("_us"), F.explode(copies).alias("_k"))
          .select(*keys, "_us", F.col("_k.c").alias("_chunk"), F.col("_k.ctx").alias("_ctx")))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(-WEEK_US, 0)
    counted = x.withColumn("plays_win", F.count(F.lit(1)).over(w)).filter(~F.col("_ctx"))
    return counted.groupBy(*keys).agg(F.max("plays_win").alias("peak_plays"))


def counts_7d_spread(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _us, plays_win): the trailing 7-day count at every distinct play time, with no
    group in one task.

    A count is a difference of two ranks: plays up to t, less plays before t - 7 days.
    Play times and these lower ends are sorted together by range partitions of (keys,
    time), so a group spreads over as many parts as its share asks for; a part counts its
    own plays, the counts of earlier parts (one row per part and group) are added, and
    a time meets its lower end by an equi-join."""
    times = p.groupBy(*keys, utc_micros("listened_at").alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.array(F.struct(F.col("_us").alias("at"), F.lit(1).alias("kind"), F.col("_n").alias("n")),
                   F.struct((F.col("_us") - WEEK_US).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")))
    both = times.select(*keys, "_us", F.explode(ends).alias("_e")).select(
        *keys, "_us", F.col("_e.at").alias("_at"), F.col("_e.kind").alias("_kind"), F.col("_e.n").alias("_n"))
    # a lower end comes before a play at its time, since that play is within the window
    dealt = both.repartitionByRange(*keys, "_at", "_kind").withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "play-ranks")
    group = Window.partitionBy(*[F.col(k) for k in keys])
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*keys, "_part", before.alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for k in [*keys, "_part"]:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"o.{k}"))
    counted = dealt.withColumn("_upto", F.sum("_n").over(within)).alias("x").join(offsets.alias("o"), same)
    ranks = counted.select(*[F.col(f"x.{k}").alias(k) for k in keys], "_us", "_kind", (F.col("_upto") + F.col("_before")).alias("_rank"))
    upper = F.max(F.when(F.col("_kind") == 1, F.col("_rank")))
    lower = F.max(F.when(F.col("_kind") == 0, F.col("_rank")))
    return ranks.groupBy(*keys, "_us").agg((upper - lower).alias("plays_win"))


def peak_7d_spread(p: DataFrame, keys: list[str]) -> DataFrame:
    """``peak_7d`` by ranks (``counts_7d_spread``): for groups of which even two weeks are more
    than one task should hold."""
    return counts_7d_spread(p, keys).groupBy(*keys).agg(F.max("plays_win").alias("peak_plays"))


def binges(plays: DataFrame, min_plays: int = 6, days: int | None = None,
           as_of=None, spread: bool = False) -> DataFrame:
    """Albums with a 7-day peak of at least ``min_plays``; album-less
    plays (NULL or '') excluded (F5).  ``spread`` counts by ranks (``peak_7d_spread``)."""
    p = utc_plays(plays, "artist_name", "album_name")
    p = p.filter(F.col("album_name").isNotNull() & (F.col("album_name") != ""))
    p = in_window(p, days, as_of)
    pk = (peak_7d_spread if spread else peak_7d)(p, ["user_id", "artist_name", "album_name"])
    return pk.filter(F.col("peak_plays") >= min_plays)


def song_binges(plays: DataFrame, min_plays: int = 5, days: int | None = None,
                as_of=None, limit: int = 25, spread: bool = False) -> DataFrame:
    """Tracks with a 7-day peak of at least ``min_plays``, top 25 per
    user by peak (ties by artist, track)."""
    p = in_window(utc_plays(plays, "artist_name", "track_name"), days, as_of)
    pk = (peak_7d_spread if spread else peak_7d)(p, ["user_id", "artist_name", "track_name"])
    pk = pk.filter(F.col("peak_plays") >= min_plays)
    return top_k(pk, limit, ["user_id"],
                 [F.desc("peak_plays"), F.asc("artist_name"), F.asc("track_name")])
