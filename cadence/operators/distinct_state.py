"""Period reports from bitmaps that merge (A8, A17): exact distinct counts that roll up.

A distinct count of a month cannot be had from those of its weeks, but sets can be united.
Every user's track names and folded artists get dense numbers, and a batch of plays becomes one
bitmap, a long, per (user, cell, kind, 64 numbers), a cell being the days that a local week and a
local month share.  Weeks, months or any other union of cells are ``bit_or`` over
cells: no play is read again, and no row is multiplied for each distinct count as
``report`` has to.  Most cells hold a few names of one user, for which Spark's ``bitmap_construct_agg``
would make 4 KB each; words of 64 bits are never more than the names, and add up in a hash aggregate.

Numbers are counted within a user, so that a user with some hundred names needs a few words a
cell whatever the size of the catalogue.  New names are numbered by their place in sorted ranges
of (user, kind, name): a user with most of the names is spread over tasks.

Both tables grow by folders (``sources.folders``): a batch that is run again under its name changes
nothing, also if it was cut off between the two.  Plays must be new (``append_new``).  Names that are
null are not counted, as in ``report``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions.timeops import check_tz, local_period
from cadence.operators.common import akey, utc_plays
from cadence.plans.session import materialize
from cadence.sources.folders import Folders

NAMES = "user_id bigint, kind string, name string, id bigint"
CELLS = "user_id bigint, week date, month date, kind string, bucket bigint, bits bigint, plays bigint"
#: Numbers in one word of bits.
WORD = 64


def cell_counts(plays: DataFrame, tz: str) -> DataFrame:
    """(user, week, month, track, folded artist, n): the batch's plays, counted once."""
    p = utc_plays(plays, "artist_name", "track_name")
    return (p.groupBy(F.col("user_id").cast("long").alias("user_id"), local_period("listened_at", tz, "week").alias("week"),
                      local_period("listened_at", tz, "month").alias("month"), "track_name", akey().alias("akey"))
             .agg(F.count(F.lit(1)).alias("n")))


def _named(counts: DataFrame) -> DataFrame:
    """(user, week, month, kind, name), as often as counted: bits and names are united anyway, so a
    distinct here would only be one more shuffle of all rows."""
    kinds = F.array(F.struct(F.lit("track").alias("kind"), F.col("track_name").alias("name")),
                    F.struct(F.lit("artist").alias("kind"), F.col("akey").alias("name")))
    return counts.select("user_id", "week", "month", F.inline(kinds)).filter(F.col("name").isNotNull())


def numbered(names: DataFrame, known: DataFrame) -> DataFrame:
    """The (user, kind, name) of ``names`` that ``known`` has not, numbered on from its numbers."""
    key = ["user_id", "kind"]
    new = names.select(*key, "name").distinct().join(known, [*key, "name"], "left_anti")
    dealt = materialize(new.repartitionByRange(*key, "name").withColumn("_part", F.spark_partition_id()), "new-names")
    parts = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_in"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*key, "_part", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    last = known.groupBy(*key).agg(F.max("id").alias("_last"))
    offsets = offsets.join(last, key, "left").withColumn("_before", F.col("_before") + F.coalesce("_last", F.lit(0))).drop("_last")
    place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("name"))
    return (dealt.withColumn("_place", place).join(offsets, [*key, "_part"])
            .select(*key, "name", (F.col("_before") + F.col("_place")).alias("id")))


def cells(counts: DataFrame, names: DataFrame) -> DataFrame:
    """The bitmaps of a batch, and its plays as rows of kind ``plays``."""
    cell = ["user_id", "week", "month"]
    bits = (_named(counts).join(names, ["user_id", "kind", "name"])
            .groupBy(*cell, "kind", F.expr(f"id DIV {WORD}").alias("bucket"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(id % {WORD} AS INT))")).alias("bits"))
            .withColumn("plays", F.lit(0).cast("long")))
    plays = counts.groupBy(*cell).agg(F.sum("n").alias("plays")).select(
        *cell, F.lit("plays").alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("long").alias("bits"), "plays")
    return bits.unionByName(plays)


def united(state: DataFrame, *keys) -> DataFrame:
    """(keys, plays, distinct_tracks, distinct_artists) over all cells of each key."""
    per = (state.groupBy("user_id", *keys, "kind", "bucket")
           .agg(F.sum("plays").alias("plays"), F.bit_count(F.bit_or("bits")).alias("_n")))
    names = [k if isinstance(k, str) else per.columns[1 + i] for i, k in enumerate(keys)]

    def of(kind: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_n"))), F.lit(0))
    return per.groupBy("user_id", *names).agg(F.sum("plays").alias("plays"), of("track").alias("distinct_tracks"),
                                              of("artist").alias("distinct_artists"))


class DistinctState:
    """The state of one zone's calendar under ``path``."""

    def __init__(self, spark: SparkSession, path: str, tz: str = "UTC"):
        self.names, self.cells = Folders(spark, f"{path}/names", NAMES), Folders(spark, f"{path}/cells", CELLS)
        self.tz = check_tz(tz)

    def add(self, plays: DataFrame, batch: str) -> None:
        """Take in a batch of new plays."""
        if batch in self.cells.applied():
            return
        counts = materialize(cell_counts(plays, self.tz), "cell-counts")
        self.names.add(numbered(_named(counts), self.names.read()), batch)
        self.cells.add(cells(counts, self.names.read()), batch)

    def merge(self) -> None:
        """Put the cells of all batches together, and all names in one folder; what is read stays the same."""
        keys = ["user_id", "week", "month", "kind", "bucket"]
        self.cells.merge(self.cells.read().groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.sum("plays").alias("plays")))
        self.names.merge(self.names.read())

    def report(self, period: str = "month") -> DataFrame:
        """A8 from the state: the rows of ``activity.report``."""
        m = united(self.cells.read(), F.col("week" if period == "week" else "month").alias("month"))
        w = Window.partitionBy("user_id").orderBy("month")
        return m.withColumn("plays_vs_prev_month", F.col("plays") - F.lag("plays").over(w))

    def years(self) -> DataFrame:
        """The same counts per calendar year, from the same cells."""
        return united(self.cells.read(), F.year("month").alias("year"))

    def all_time(self) -> DataFrame:
        """The same counts per user."""
        return united(self.cells.read())
