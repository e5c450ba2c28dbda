"""Cross-query invariants on the driver's sf0.001 tables, several zones."""

import pytest
from pyspark.sql import functions as F

from cadence.functions.timeops import PART_NAMES
from cadence.operators import activity as A
from cadence.operators import binges as B
from cadence.operators import history as H

AS_OF = "2024-01-31 00:00:00"


@pytest.mark.parametrize("tz", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_every_clock_cell_equals_its_drill_down(small, tz):
    cells = A.clock(small.plays, tz, None)
    names = F.array(*[F.lit(p) for p in PART_NAMES])
    searches = cells.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string"),
                    F.col("part").cast("string")).alias("search_id"),
        "user_id",
        F.concat(F.lit("date:"), F.col("day").cast("string"), F.lit(" part:"),
                 F.element_at(names, F.col("part") + 1)).alias("query"),
        F.lit(tz).alias("tz"), F.col("plays").alias("expected"))
    totals = H.totals(small.plays, searches.drop("expected"))
    bad = searches.join(totals, "search_id").filter(F.col("total") != F.col("expected"))
    assert searches.count() > 0 and bad.count() == 0


def test_total_equals_matches(small):
    m = H.matches(small.plays, small.searches).groupBy("search_id").count()
    t = H.totals(small.plays, small.searches)
    bad = t.join(m, "search_id", "left").filter(F.coalesce("count", F.lit(0)) != F.col("total"))
    assert bad.count() == 0


def test_paging_is_a_partition_of_the_order(small):
    full = H.page(small.plays, small.searches, limit=20, offset=0)
    a = H.page(small.plays, small.searches, limit=10, offset=0)
    b = H.page(small.plays, small.searches, limit=10, offset=10)
    assert full.exceptAll(a.unionByName(b)).count() == 0
    assert a.unionByName(b).exceptAll(full).count() == 0


def test_wider_window_never_counts_less(small):
    wide = A.clock(small.plays, "UTC", 30, AS_OF).withColumnRenamed("plays", "w")
    narrow = A.clock(small.plays, "UTC", 7, AS_OF)
    j = narrow.join(wide, ["user_id", "day", "part"], "left")
    assert j.filter(F.col("w").isNull() | (F.col("w") < F.col("plays"))).count() == 0


def test_binge_chunking_matches_plain_window(small):
    """The skew-split 7-day peak equals a plain RANGE window over whole groups."""
    p = small.plays_long.select("user_id", "artist_name", "album_name", "listened_at")
    keys = ["user_id", "artist_name", "album_name"]
    split = B.peak_7d(p, keys)
    plain = p.selectExpr(*keys, """COUNT(*) OVER (PARTITION BY user_id, artist_name, album_name
        ORDER BY listened_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS w""") \
        .groupBy(*keys).agg(F.max("w").alias("peak_plays"))
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_streak_days_cover_every_play_day(small):
    s = A.streaks(small.plays, "America/New_York")
    days = s.groupBy("user_id").agg(F.sum("length_days").alias("n"))
    distinct = (small.plays.select("user_id", F.to_date(F.convert_timezone(
        F.lit("UTC"), F.lit("America/New_York"), "listened_at")).alias("d")).distinct()
        .groupBy("user_id").count())
    assert days.join(distinct, "user_id").filter(F.col("n") != F.col("count")).count() == 0
