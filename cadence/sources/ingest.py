"""Idempotent appends and latest-wins state over plain parquet (S7-S9, S12,
S13).

The reference relies on primary keys with ``ON CONFLICT DO NOTHING`` (first
row wins) and an upsert (last row wins).  Here a batch is reduced to one row
per key with an aggregate -- ``min_by``/``max_by`` over an arrival order,
which combines map-side, so a hot key is pre-aggregated before the shuffle --
and rows whose key is already stored are removed with a left anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_lit
from cadence.schemas import DURATION_KEY, PLAY_KEY, TAG_KEY, TOP_TRACK_KEY


def first_per_key(batch: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """The row with the smallest ``order_col`` for every key; rows arriving
    at the same position are ordered by their remaining columns, so the pick
    is deterministic."""
    rest = [c for c in batch.columns if c not in key and c != order_col]
    row = F.min_by(F.struct(*rest), F.struct(F.col(order_col), *[F.col(c) for c in rest]))
    return batch.groupBy(*key).agg(row.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append_new(batch: DataFrame, key: list[str], order_col: str,
               existing: DataFrame | None = None) -> DataFrame:
    """Rows of ``batch`` to append: first arrival per key, keys already in
    ``existing`` dropped.  Re-running with the same batch appends nothing."""
    firsts = first_per_key(batch, key, order_col)
    if existing is not None:
        firsts = firsts.join(existing.select(*key), key, "left_anti")
    return firsts


def dedupe_plays(batch: DataFrame, order_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Plays keyed on (user, track, time) -- artist is not in the key."""
    return append_new(batch, PLAY_KEY, order_col, existing)


def dedupe_durations(batch: DataFrame, order_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Track lengths; the first value stored for a track wins."""
    return append_new(batch, DURATION_KEY, order_col, existing)


def dedupe_tags(batch: DataFrame, order_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Raw artist tags."""
    return append_new(batch, TAG_KEY, order_col, existing)


def dedupe_top_tracks(batch: DataFrame, order_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Artist top tracks."""
    return append_new(batch, TOP_TRACK_KEY, order_col, existing)


def feedback_state(events: DataFrame, order_cols: tuple[str, ...] = ("event_ts",)) -> DataFrame:
    """The current verdicts from an event log of (user_id, artist_name,
    action in seed | block | clear, order columns).

    Latest event per (user, lower(artist)) wins and carries its spelling; a
    'clear' deletes the row; every set resets ``expanded_at`` to NULL."""
    order = F.struct(*[F.col(c) for c in order_cols])
    last = F.max_by(F.struct("artist_name", "action"), order)
    return (events.groupBy("user_id", F.lower("artist_name").alias("_k"))
                  .agg(last.alias("_l"))
                  .filter(F.col("_l.action") != "clear")
                  .select("user_id", F.col("_l.artist_name").alias("artist_name"),
                          F.col("_l.action").alias("verdict"),
                          F.lit(None).cast("timestamp_ntz").alias("expanded_at")))


def mark_seeds_expanded(feedback: DataFrame, as_of, user_ids: DataFrame | None = None) -> DataFrame:
    """Stamp pending seeds (of the given users) as looked up."""
    pending = (F.col("verdict") == "seed") & F.col("expanded_at").isNull()
    if user_ids is not None:
        flagged = user_ids.select("user_id").distinct().withColumn("_sel", F.lit(True))
        feedback = feedback.join(flagged, "user_id", "left")
        pending = pending & F.col("_sel").isNotNull()
    out = feedback.withColumn("expanded_at", F.when(pending, as_of_lit(as_of)).otherwise(F.col("expanded_at")))
    return out.drop("_sel") if user_ids is not None else out


def advance_sync_marks(users: DataFrame, runs: DataFrame) -> DataFrame:
    """Move each user's high-water mark to the *start* time of their
    latest completed sync run (never backwards).  ``runs`` has (user_id,
    started_at, completed)."""
    done = (runs.filter(F.col("completed"))
                .groupBy("user_id").agg(F.max("started_at").alias("_start")))
    return (users.join(done, "user_id", "left")
                 .select("user_id",
                         F.when(F.col("_start").isNull(), F.col("last_synced_at"))
                          .when(F.col("last_synced_at").isNull(), F.col("_start"))
                          .otherwise(F.greatest("last_synced_at", "_start")).alias("last_synced_at")))


def completed_runs(runs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``runs`` (user_id, started_at, completed) with the runs that had a rejected
    page (``rejected``: user_id, started_at) marked as not completed."""
    bad = rejected.select("user_id", "started_at").distinct().withColumn("_bad", F.lit(True))
    return (runs.join(bad, ["user_id", "started_at"], "left")
                .withColumn("completed", F.col("completed") & F.col("_bad").isNull()).drop("_bad"))
