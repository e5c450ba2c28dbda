"""Refreshes of some users, commits as a reader sees them, and binge alerts near a batch."""

import datetime as dt
import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cadence.operators import recommend as R
from cadence.operators import taste as TS
from cadence.operators.binges import binges
from cadence.plans.session import materialize, scratch_path
from cadence.schemas import PLAYS
from cadence.streaming import streams as ST

START = dt.datetime(2024, 1, 1)


def corpus(spark, changed=False):
    rows = [(f"Artist {i}", f"tag {t}", 10 + (i * t) % 7) for i in range(24) for t in range(6) if (i + t) % 3]
    rows += [(f"Other {i}", f"rare {i % 2}", 5 + i) for i in range(6)]
    if changed:  # the weights of one artist of the rare tags
        rows = [(a, t, w + (50 if a == "Other 2" else 0)) for a, t, w in rows] + [("Other 2", "rare 1", 9)]
    return spark.createDataFrame(rows, "artist_name string, tag string, weight int")


def plays(spark, users=6, seed=1):
    rng = random.Random(seed)
    rows = [(u, f"Artist {rng.randrange(12)}" if u < 4 else f"Other {rng.randrange(2)}", f"t{rng.randrange(9)}", None,
             START + dt.timedelta(hours=rng.randrange(800))) for u in range(users) for _ in range(12)]
    return spark.createDataFrame(rows, PLAYS)


def lists(df):
    return sorted((r.user_id, r["rank"], r.artist_name, r.score) for r in df.collect())


def test_some_users_renewed_equal_a_whole_refresh(spark):
    p, c = materialize(plays(spark)), materialize(corpus(spark))
    newer = (F.col("user_id") == 2) & (F.col("listened_at") > F.lit("2024-01-15").cast("timestamp_ntz"))
    table = R.PublishedLists(spark, scratch_path(spark, "lists"))
    table.refresh(p.filter(~newer), c, None, "2024-03-01", k=4)
    before, version = lists(table.read()), table.folders.version()
    opinions = spark.createDataFrame([(0, before[0][2], "block", None)], "user_id long, artist_name string, verdict string, expanded_at timestamp_ntz")
    touched = p.filter(newer).select("user_id").unionByName(opinions.select("user_id"))
    table.refresh(p, c, opinions, "2024-03-01", k=4, users=touched)
    whole = lists(R.refresh(p, c, opinions, as_of="2024-03-01", k=4))
    assert lists(table.read()) == whole != before
    assert lists(table.read(version)) == before  # a reader that began before the commit
    written = spark.read.parquet(f"{table.folders.path}/data/{table.folders.live()[-1]}")
    assert {r.user_id for r in written.select("user_id").distinct().collect()} == {0, 2}
    table.merge()
    assert lists(table.read()) == whole and len(table.folders.live()) == 1


def test_a_reader_between_write_and_commit_sees_the_old_lists(spark):
    table = R.PublishedLists(spark, scratch_path(spark, "lists"))
    schema = "user_id long, artist_name string, score double, rank int"
    table.publish(spark.createDataFrame([(1, "A", 0.5, 1), (1, "B", 0.4, 2), (2, "C", 0.3, 1)], schema))
    table.folders.write(spark.createDataFrame([(1, "Z", 0.9, 1)], schema).withColumn("edition", F.lit(9)), "lists-9")
    assert [r[:2] for r in map(tuple, table.read().orderBy("user_id", "rank").collect())] == [(1, "A"), (1, "B"), (2, "C")]
    table.publish(spark.createDataFrame([(1, None, None, None)], schema))  # now empty
    assert [tuple(r) for r in table.read().collect()] == [(2, "C", 0.3, 1)]


def test_users_of_changed_artists_are_enough(spark):
    p = materialize(plays(spark))
    old, new = (materialize(TS.artist_vectors(corpus(spark, x))) for x in (False, True))
    scores = materialize(TS.play_scores(p, "2024-03-01"))
    taste = TS.taste_vectors(scores, old).unionByName(TS.taste_vectors(scores, new))
    found = {r.user_id for r in R.affected_users(old, new, taste).collect()}
    assert found == {4, 5}
    table = R.PublishedLists(spark, scratch_path(spark, "lists"))
    table.refresh(p, corpus(spark), None, "2024-03-01", k=4)
    table.refresh(p, corpus(spark, True), None, "2024-03-01", k=4, users=R.affected_users(old, new, taste))
    assert lists(table.read()) == lists(R.refresh(p, corpus(spark, True), None, as_of="2024-03-01", k=4))


def test_binge_alerts_from_the_days_around_each_batch(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.choice("AB"), f"t{i}", rng.choice(["x", "y", None]), START + dt.timedelta(minutes=rng.randrange(60 * 24 * 60)))
            for i in range(160)]
    base = scratch_path(spark, "binge-test")
    run = ST.binge_alerts(f"{base}/plays", f"{base}/alerts", min_plays=4)
    rng.shuffle(rows)  # backfill and new plays in any order
    for i in range(3):
        run(spark.createDataFrame(rows[i::3], PLAYS), i)
    got = sorted(map(tuple, ST.latest_alerts(spark, f"{base}/alerts").collect()))
    assert got == sorted(map(tuple, binges(spark.createDataFrame(rows, PLAYS), min_plays=4).select(
        "user_id", "artist_name", "album_name", "peak_plays").collect())) and got
    touched = spark.createDataFrame([(1, "A", "x", dt.date(2024, 1, 20))], "user_id long, artist_name string, album_name string, play_date date")
    out = io.StringIO()
    with redirect_stdout(out):
        ST.binge_plays(spark, f"{base}/plays", touched, 4).explain("formatted")
    scans = [line for line in out.getvalue().splitlines() if "PartitionFilters" in line]
    assert scans and all("2024-01-13" in s and "2024-01-27" in s for s in scans)
