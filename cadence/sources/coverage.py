"""Which spans of time of a user's history have been fetched.

A backfill runs newest first and may be cut off anywhere, and the next sync starts from its
mark: what lies between is known only from the spans of the pages that were stored.
A span is [since, until).  Spans of a user are kept as their union; what is missing
between the start of the history and a given time are its gaps, to be fetched next,
newest first.

The union is a running maximum over a user's spans in order of their start: a span that
starts after everything before it has ended opens a new island.  Islands of a user with
very many spans are first united within calendar months, then over months, so that the
last window holds a user's islands, not the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_lit
from cadence.sources.folders import Folders

SPANS = "user_id bigint, since timestamp_ntz, until timestamp_ntz"


def _united(spans: DataFrame, keys: list[str | Column]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("since", "until")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_opens", F.when(reached.isNull() | (F.col("since") > reached), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def united(spans: DataFrame) -> DataFrame:
    """(user_id, since, until): the spans of each user as disjoint ones that do not touch.
    Spans that are empty, reversed or without an end or user say nothing."""
    real = spans.select("user_id", "since", "until").filter("user_id IS NOT NULL AND since < until")
    by_month = _united(real.withColumn("_month", F.trunc("since", "month")), ["user_id", "_month"]).drop("_month")
    return _united(by_month, ["user_id"])


def gaps(spans: DataFrame, until=None, first: DataFrame | None = None) -> DataFrame:
    """(user_id, since, until, pos): what the spans of a user leave out, newest first.

    Between spans always; after the last one up to ``until`` if given; before the first one from
    ``first`` (user_id, since: the start of the user's history) if given."""
    known = united(spans)
    if first is not None:  # an empty stretch at the start of the history
        start = first.select("user_id", "since", F.col("since").alias("until")).filter("since IS NOT NULL")
        known = known.unionByName(start)
    order = Window.partitionBy("user_id").orderBy("since", "until")
    reached = F.max("until").over(order)
    ends = F.lead("since").over(order)
    last = ends if until is None else F.coalesce(ends, as_of_lit(until))
    if until is not None:
        last = F.least(last, as_of_lit(until))
    found = known.select("user_id", reached.alias("since"), last.alias("until")).filter("since < until")
    newest = Window.partitionBy("user_id").orderBy(F.desc("since"))
    return found.withColumn("pos", F.row_number().over(newest))


class Coverage:
    """The fetched spans as a state that grows by batches; also a foreachBatch sink."""

    def __init__(self, spark: SparkSession, path: str):
        self.folders = Folders(spark, path, SPANS)

    def add(self, spans: DataFrame, batch: str) -> None:
        self.folders.add(united(spans), batch)

    def write_batch(self, spans: DataFrame, epoch_id: int) -> None:
        from cadence.streaming.streams import batch_name

        self.add(spans, batch_name(spans, epoch_id))

    def merge(self) -> None:
        """Unite the spans of all batches into one folder."""
        self.folders.merge(self.spans())

    def spans(self) -> DataFrame:
        return united(self.folders.read())

    def gaps(self, until=None, first: DataFrame | None = None) -> DataFrame:
        return gaps(self.folders.read(), until, first)
