"""A ledger of plays that come behind the watermark.

Spark's watermark drops late rows of a stateful operator unseen.  ``LateLedger`` is the
foreachBatch form that counts on time and loses nothing: the mark is the newest play of all earlier
batches less ``delay``, as a watermark's; a play at or before it is late.  Every new play (first
arrival of its key, replays are none) is stored with the number of its batch and whether it
was late:

* ``counted``: the plays that an on-time count holds,
* ``ledger``: the late ones, i.e. plays sent less plays counted,
* ``corrections``: the (user, local day, part) cells that late plays change, with both counts,
* ``batches``: sent, counted, late and replayed plays of each batch, from ``observe`` metrics that
  come with the batch's write.

A batch is one commit of ``sources.folders``: readers see all of it or nothing, and a retry
under the same name changes nothing.  Only the stored plays of a batch's dates are read back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.timeops import check_tz, local_date, part_of_day
from cadence.plans.session import materialize_counted
from cadence.schemas import PLAY_KEY
from cadence.sources.folders import Folders
from cadence.sources.ingest import append_new
from cadence.streaming.streams import batch_name

STORED = ("user_id bigint, artist_name string, track_name string, album_name string, listened_at timestamp_ntz, "
          "play_date date, batch string, late boolean")
SEEN = "batch string, sent bigint, newest timestamp_ntz"


class LateLedger:
    def __init__(self, spark: SparkSession, path: str, delay: dt.timedelta):
        self.spark, self.delay = spark, delay
        self.plays, self.seen = Folders(spark, f"{path}/plays", STORED), Folders(spark, f"{path}/seen", SEEN)

    def mark(self, name: str) -> dt.datetime | None:
        """The mark for batch ``name``: none before the first play."""
        newest = self.seen.read().filter(F.col("batch") != name).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def write_batch(self, batch: DataFrame, epoch_id: int) -> None:
        """The foreachBatch function."""
        name = batch_name(batch, epoch_id)
        if name in self.plays.applied():
            return
        cols = ["user_id", "artist_name", "track_name", "album_name", "listened_at"]
        b = batch.select(*cols).withColumn("play_date", F.to_date("listened_at")).withColumn("_arrival", F.lit(epoch_id))
        b, seen = materialize_counted(b, "late-batch", newest=F.max("listened_at"))
        self.seen.add(self.spark.createDataFrame([(name, seen["rows"], seen["newest"])], SEEN), name)
        days = [r[0] for r in b.select("play_date").distinct().collect()]  # bounded by the calendar
        stored = self.plays.read().filter(F.col("play_date").isin(days)) if days else self.plays.read().limit(0)
        mark = self.mark(name)
        late = F.lit(False) if mark is None else F.col("listened_at") <= F.lit(mark.isoformat(sep=" ")).cast("timestamp_ntz")
        new = append_new(b, PLAY_KEY, "_arrival", stored).select(*cols, "play_date")
        self.plays.add(new.withColumns({"batch": F.lit(name), "late": late}).sortWithinPartitions("play_date"), name)

    def counted(self) -> DataFrame:
        return self.plays.read().filter(~F.col("late")).drop("late", "play_date")

    def ledger(self) -> DataFrame:
        return self.plays.read().filter("late").drop("late", "play_date")

    def batches(self) -> DataFrame:
        per = self.plays.read().groupBy("batch").agg(F.count_if(~F.col("late")).alias("counted"), F.count_if("late").alias("late"))
        none = F.lit(0).cast("long")
        out = self.seen.read().select("batch", "sent").join(per, "batch", "left").withColumns(
            {"counted": F.coalesce("counted", none), "late": F.coalesce("late", none)})
        return out.withColumn("replayed", F.col("sent") - F.col("counted") - F.col("late"))

    def corrections(self, tz: str = "UTC") -> DataFrame:
        """(user_id, day, part, counted, plays) of every clock cell with a late play: the count on
        time and the whole one."""
        tz = check_tz(tz)
        cell = self.plays.read().groupBy("user_id", local_date("listened_at", tz).alias("day"), part_of_day("listened_at", tz).alias("part"))
        return (cell.agg(F.count_if(~F.col("late")).alias("counted"), F.count(F.lit(1)).alias("plays"))
                .filter(F.col("counted") < F.col("plays")))
