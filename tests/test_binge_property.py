"""Property test: the chunked 7-day peak equals a brute-force count, with a
hot group, tied timestamps (window peers) and plays on chunk boundaries."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.operators.binges import counts_7d_spread, peak_7d, peak_7d_spread

EPOCH = dt.datetime(1970, 1, 1)
WEEK = dt.timedelta(days=7)
# timestamps on a 6-hour grid around a chunk boundary (chunk k starts at
# EPOCH + k weeks): many ties (window peers) and plays exactly 7 days apart
# (the inclusive edge of the frame)
_offsets = st.integers(min_value=-12, max_value=96).map(lambda h: h * 360)  # minutes
_play = st.tuples(st.sampled_from(["hot", "hot", "hot", "cold", "warm"]), _offsets)


def brute(plays):
    peaks = {}
    for key, t in plays:
        n = sum(1 for k2, t2 in plays if k2 == key and t - WEEK <= t2 <= t)
        peaks[key] = max(peaks.get(key, 0), n)
    return peaks


@settings(max_examples=4, deadline=None)
@given(st.lists(_play, min_size=1, max_size=120))
def test_peak_matches_brute_force(spark, raw):
    boundary = EPOCH + 2800 * WEEK  # a chunk boundary in 2023
    plays = [(k, boundary + dt.timedelta(minutes=m)) for k, m in raw]
    df = spark.createDataFrame([(1, k, t) for k, t in plays], "user_id long, g string, listened_at timestamp_ntz")
    got = {r.g: r.peak_plays for r in peak_7d(df, ["user_id", "g"]).collect()}
    assert got == brute(plays)
    spread = {r.g: r.peak_plays for r in peak_7d_spread(df, ["user_id", "g"]).collect()}
    assert spread == brute(plays)


def test_one_group_with_all_plays_in_a_week_spreads_over_tasks(spark):
    """The sorted ranges that count the plays hold about as many rows each."""
    df = spark.range(12_000).selectExpr("1L AS user_id", "'hot' AS g",
                                        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST((id * 7919) % 600000 AS INT)) AS listened_at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = counts_7d_spread(df, ["user_id", "g"])
        top = counted.agg({"plays_win": "max"}).first()[0]
        files = [f for f in counted.inputFiles() if "play-ranks" in f]
        sizes = sorted(r["n"] for r in spark.read.parquet(files[0].rsplit("/", 1)[0]).groupBy("_part").agg({"*": "count"}).toDF("p", "n").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert top == 12_000
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_null_keys_and_no_plays(spark):
    rows = [(1, None, EPOCH + WEEK), (1, None, EPOCH + 2 * WEEK), (1, "a", EPOCH + WEEK), (None, "a", EPOCH)]
    df = spark.createDataFrame(rows, "user_id long, g string, listened_at timestamp_ntz")
    assert sorted(map(repr, peak_7d_spread(df, ["user_id", "g"]).collect())) == sorted(map(repr, peak_7d(df, ["user_id", "g"]).collect()))
    assert peak_7d_spread(df.limit(0), ["user_id", "g"]).count() == 0
