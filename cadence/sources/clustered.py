"""The plays table clustered by user (S1): per-user questions without a shuffle.

Plays are written in buckets of ``user_id``, one file for each bucket and month, sorted by user and
time.  An operator whose keys begin with ``user_id`` (streaks, discovery, counts a user) then
aggregates and ranks where the rows lie: its plan has no Exchange at all.  ``report`` keeps one, as
Spark's Expand for several distinct counts forgets how rows lie.  Month folders
prune time ranges as in ``tables``.

A bucket is read by one task, so a user with a large share of all plays must not sit in one.  Users
with more than ``HOT`` times a bucket's mean share (at most ``buckets / HOT`` of them) are kept apart,
unbucketed; ``apply`` runs an operator over both and unites the results, which is the
operator's result over all plays, as no user is in both.

``append`` adds the plays of a batch whose keys are not stored yet, as files beside the others, one
for each bucket and month it touches whatever the number of tasks; ``compact`` writes everything anew as a next version, with one file a bucket and month and
the hot users found anew, and names it in one commit (``sources.folders``).  Readers keep the version they
began with.  Every ``append`` goes to the newest version; one writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.timeops import as_of_ntz
from cadence.operators.common import utc_plays
from cadence.plans.session import bounded_broadcast, materialize
from cadence.schemas import PLAY_KEY
from cadence.sources.folders import Folders
from cadence.sources.ingest import append_new

#: A user is hot above this many times the mean share of a bucket.
HOT = 2
COLUMNS = "user_id bigint, artist_name string, track_name string, album_name string, listened_at timestamp_ntz, month date"


class ClusteredPlays:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions = Folders(spark, path, COLUMNS)

    # --- the two parts of a version ---------------------------------------------
    def _place(self, version: str, part: str) -> str:
        return f"{self.path}/data/{version}/{part}"

    def _version(self) -> str | None:
        live = self.versions.live()
        return live[0] if live else None

    def _bucketed(self, version: str) -> str:
        """The catalogue's name of a version's bucketed part, entered where the session lacks it: files
        alone do not tell Spark that they are buckets."""
        place = self._place(version, "cold")
        name = f"plays_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet OPTIONS (path '{place}') PARTITIONED BY (month) "
                           f"CLUSTERED BY (user_id) SORTED BY (user_id, listened_at) INTO {self.buckets} BUCKETS")
        return name

    def _write(self, plays: DataFrame, version: str, hot: DataFrame) -> None:
        """``plays`` is read twice: a table, not a plan that would run twice."""
        name = self._bucketed(version)
        # a month of a bucket lies in one task, so it is one file a write, however many tasks there are
        cold = plays.join(hot, "user_id", "left_anti").repartition("month", F.pmod(F.hash("user_id"), F.lit(self.buckets)))
        columns = [c.split()[0] for c in COLUMNS.split(", ")]
        (cold.select(columns).write.format("parquet").mode("append").partitionBy("month")
             .bucketBy(self.buckets, "user_id").sortBy("user_id", "listened_at")
             .option("path", self._place(version, "cold")).saveAsTable(name))
        apart = plays.join(hot, "user_id", "left_semi").hint("rebalance", "month").select(columns)
        apart.sortWithinPartitions("user_id", "listened_at").write.mode("append").partitionBy("month").parquet(self._place(version, "hot"))

    def _hot_users(self, version: str) -> DataFrame:
        users = self.spark.read.schema("user_id bigint").parquet(self._place(version, "users"))
        return bounded_broadcast(users, self.buckets)

    # --- writing ------------------------------------------------------------------
    def _new_version(self, plays: DataFrame) -> None:
        version = f"v{self.versions.version() + 1}"
        counts = materialize(plays.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user-counts")
        total = counts.select(F.sum("n")).scalar()
        hot = counts.filter(F.col("n") * self.buckets > HOT * total).select("user_id")
        hot.write.mode("overwrite").parquet(self._place(version, "users"))
        self._write(plays, version, self._hot_users(version))
        self.versions.commit([version])

    def write(self, plays: DataFrame) -> None:
        """Make ``plays`` the table."""
        self._new_version(materialize(_dated(plays), "clustered-plays"))

    def append(self, plays: DataFrame) -> None:
        """Add the plays whose keys are not stored yet (first of a key by artist and album)."""
        version = self._version()
        if version is None:
            self.write(plays)
            return
        batch = materialize(_dated(plays), "clustered-batch").withColumn("_arrival", F.lit(0))
        months = [r[0] for r in batch.select("month").distinct().collect()]  # bounded by the calendar
        stored = self._all(version).filter(F.col("month").isin(months))
        new = materialize(append_new(batch, PLAY_KEY, "_arrival", stored), "clustered-new")
        self._write(new, version, self._hot_users(version))

    def compact(self) -> None:
        """Rewrite the newest version with one file a bucket and month."""
        self._new_version(self._all(self._version()))

    # --- reading ------------------------------------------------------------------
    def _parts(self, version: str) -> tuple[DataFrame, DataFrame]:
        name = self._bucketed(version)
        self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name), self.spark.read.schema(COLUMNS).parquet(self._place(version, "hot"))

    def _all(self, version: str) -> DataFrame:
        cold, hot = self._parts(version)
        return cold.unionByName(hot)

    def parts(self, since=None, until=None) -> tuple[DataFrame, DataFrame]:
        """(bucketed plays, plays of the hot users), with optional [since, until) bounds that prune
        month folders."""
        def bounded(df: DataFrame) -> DataFrame:
            if since is not None:
                s = as_of_ntz(since)
                df = df.filter((F.col("month") >= F.lit(s.date().replace(day=1))) &
                               (F.col("listened_at") >= F.lit(s.isoformat(sep=" ")).cast("timestamp_ntz")))
            if until is not None:
                u = as_of_ntz(until)
                df = df.filter((F.col("month") <= F.lit(u.date())) &
                               (F.col("listened_at") < F.lit(u.isoformat(sep=" ")).cast("timestamp_ntz")))
            return df.drop("month")
        cold, hot = self._parts(self._version())
        return bounded(cold), bounded(hot)

    def read(self, since=None, until=None) -> DataFrame:
        cold, hot = self.parts(since, until)
        return cold.unionByName(hot)

    def apply(self, operator: Callable[[DataFrame], DataFrame], since=None, until=None) -> DataFrame:
        """``operator`` over all plays; each of its result rows must depend on one user's plays only."""
        cold, hot = self.parts(since, until)
        return operator(cold).unionByName(operator(hot))


def _dated(plays: DataFrame) -> DataFrame:
    p = utc_plays(plays, "artist_name", "track_name", "album_name")
    return p.withColumns({"user_id": F.col("user_id").cast("long"), "month": F.trunc("listened_at", "month")})
