"""Small helpers every operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.timeops import since, to_utc_ntz


# Spark's own threshold for trimming ranked groups before the shuffle, and the
# parts in which larger ones are trimmed.
GROUP_LIMIT = 1000
PARTS = 64


def utc_plays(plays: DataFrame, *cols: str) -> DataFrame:
    """Project ``plays`` to ``cols`` (plus user_id, listened_at) with
    ``listened_at`` normalised to UTC wall clock.  Projecting first keeps the
    parquet ReadSchema down to the columns the operator really reads."""
    want = ["user_id", *[c for c in cols if c not in ("user_id", "listened_at")]]
    dtype = plays.schema["listened_at"].dataType
    return plays.select(*want, to_utc_ntz("listened_at", dtype).alias("listened_at"))


def in_window(df: DataFrame, days: int | None, as_of) -> DataFrame:
    cond = since("listened_at", days, as_of)
    return df if cond is None else df.filter(cond)


def akey(col: str = "artist_name") -> Column:
    """Case-folded artist key."""
    return F.lower(F.col(col))


def round_half_up_ratio(num: Column, den: Column, digits: int) -> Column:
    """``round(num / den, digits)`` in exact decimal arithmetic, as a double.

    Decimal, not binary floating point, so ties round up exactly like a SQL
    NUMERIC ``ROUND`` (0.125 -> 0.13)."""
    q = num.cast("decimal(38,0)") / den.cast("decimal(38,0)")
    return F.round(q, digits).cast("double")


def top_k(df: DataFrame, k: int, partition: list[str], order: list[Column],
          rank_col: str | None = None) -> DataFrame:
    """Per-partition top-k by ``row_number``.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark itself trims each
    task's groups to k rows before the shuffle.  For any k the rows are first
    ranked within ``PARTS`` parts of a group and trimmed to k there, so that the
    final sort of a hot group reads at most ``PARTS`` x k rows."""
    from pyspark.sql import Window
    name = rank_col or "_rn"
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(PARTS))
        df = df.withColumn("_part", part)
        inner = Window.partitionBy(*partition, "_part").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k).drop("_rank", "_part")
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def modal_spelling(counts: DataFrame, keys: list[str], name: str = "artist_name",
                   count_col: str = "n") -> DataFrame:
    """The most frequent spelling per ``keys`` from per-spelling counts; ties
    go to the lowest spelling (as ``mode() WITHIN GROUP (ORDER BY name)``).

    A min over struct(-count, name) is a plain hash aggregate with map-side
    partial results -- much cheaper than the generic ``mode`` buffer."""
    best = F.min(F.struct((-F.col(count_col)).alias("_nn"), F.col(name).alias("_v")))
    return counts.groupBy(*keys).agg(best.alias("_m")).select(*keys, F.col("_m._v").alias(name))
