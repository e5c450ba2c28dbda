"""Streaming forms give the batch answers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cadence.operators import activity as A
from cadence.operators import binges as B
from cadence.plans.session import read_table, scratch_path
from cadence.sources import ingest as I
from cadence.sources import payloads as P
from cadence.sources import testpages as TP
from cadence.streaming import jobs as SJ
from cadence.streaming import streams as ST
from tests.conftest import LEA

NY = "America/New_York"


def _land_in_order(spark, plays, n_files):
    """Land pages file by file (ascending modification time, so a
    one-file-per-trigger stream sees event time move forward)."""
    path = scratch_path(spark, "landing-test")
    files = TP.replayed_files(plays, rows_per_file=max(1, plays.count() // n_files + 1))
    for f in range(n_files + 1):
        pages = TP.render_recent_tracks(files.filter(F.col("file") == f))
        pages.write.mode("overwrite").text(f"{path}/part-{f:04d}")
        pages.write.mode("append").text(f"{path}/all")
    return f"{path}/all"


def test_a_large_landing_has_no_more_files_than_a_small_one(spark):
    """Files a micro-batch are fixed, so the batches of a stream follow the files of its landing."""
    n = 60_000
    plays = spark.range(n, numPartitions=4).select(
        F.col("id").alias("play_id"), (F.col("id") % 3).alias("user_id"), F.lit("A").alias("artist_name"), F.lit("T").alias("track_name"),
        F.lit("Alb").alias("album_name"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7)").alias("listened_at"))
    path = TP.land_replayed(spark, plays, "large")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    files, folders = texts.agg(F.count("*"), F.count_distinct(F.regexp_extract("path", "file=([0-9]+)", 1))).first()
    assert files == folders <= TP.FILES + 1
    landed = P.parse_recent_tracks(spark.read.text(path))
    assert landed.count() == n + n // 10 and landed.select("username", "listened_at").distinct().count() == n
    # the landing of few plays is cut as before
    assert TP.rows_per_file(plays.limit(0)) == TP.rows_per_file(plays.filter("play_id < 5000")) == TP.ROWS_PER_FILE


def _users(plays):
    return (plays.select("user_id").distinct()
            .withColumn("username", F.concat(F.lit("user-"), F.col("user_id").cast("string"))))


def test_stream_dedupe_multi_batch(spark, small):
    plays = small.plays
    path = _land_in_order(spark, plays, 4)
    stream = ST.plays_from_landing(spark, path, _users(plays), max_files_per_trigger=1)
    out = SJ.drain(ST.dedupe_plays_stream(stream, "7 days"), "t_dedupe")
    batch = P.parse_recent_tracks(TP.render_recent_tracks(plays)).join(_users(plays), "username")
    cols = ["user_id", "artist_name", "track_name", "album_name", "listened_at"]
    assert out.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(out.select(cols)).count() == 0


def test_live_clock_equals_batch_clock(spark, small):
    plays = small.plays
    path = _land_in_order(spark, plays, 3)
    stream = ST.plays_from_landing(spark, path, _users(plays), max_files_per_trigger=1)
    live = SJ.drain(ST.live_clock(stream, NY, delay="7 days"), "t_clock", mode="update")
    final = live.groupBy("user_id", "day", "part").agg(F.max("plays").alias("plays"))
    secs = plays.withColumn("listened_at", F.date_trunc("second", "listened_at").cast("timestamp_ntz"))
    batch = A.clock(secs, NY, None)
    assert final.exceptAll(batch).count() == 0 and batch.exceptAll(final).count() == 0


def test_a_stream_has_as_many_state_stores_as_cores(spark):
    """Each state store is written in every micro-batch, so Spark's 200 partitions are not a stream's."""
    plays = spark.range(50).select(
        F.col("id").alias("play_id"), (F.col("id") % 3).alias("user_id"), F.lit("A").alias("artist_name"), F.lit("T").alias("track_name"),
        F.lit("Alb").alias("album_name"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("listened_at"))
    path, ck, key = _land_in_order(spark, plays, 1), scratch_path(spark, "stores-test"), "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        live = SJ.drain(ST.live_clock(ST.plays_from_landing(spark, path, _users(plays)), NY, delay="7 days"), "t_stores", "update", ck)
        assert spark.conf.get(key) == "64"  # batch queries keep theirs
        assert live.count() == A.clock(plays, NY, None).count()
    finally:
        spark.conf.set(key, given)
    cores = max(SJ.LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)
    for step in ("0", "1"):
        assert len([d for d in os.listdir(f"{ck.removeprefix('file:')}/state/{step}") if d.isdigit()]) == min(64, cores)


def test_a_batch_opens_no_stored_file_for_its_schema_and_counts_no_users(spark):
    """What a micro-batch does beside its own plays: no job for a schema, no pass over the whole table for the users."""
    import __spark_entry__ as E

    sc = spark.sparkContext
    plays = spark.range(20).select(
        F.col("id").alias("play_id"), (F.col("id") % 3).alias("user_id"), F.lit("A").alias("artist_name"), F.lit("T").alias("track_name"),
        F.lit("Alb").alias("album_name"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("listened_at"))
    path = scratch_path(spark, "stored")
    plays.write.parquet(path)
    sc.setJobGroup("schema-test", "")
    try:
        stored = read_table(spark, path, plays.select("user_id", "listened_at").schema)
        assert not sc.statusTracker().getJobIdsForGroup("schema-test")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert stored.columns == ["user_id", "listened_at"] and stored.count() == 20
    assert read_table(spark, path + "-none", plays.schema) is None

    class Tables:
        pass

    t = Tables()
    t.spark, t.plays = spark, plays
    plan = E._landed_stream(t, "users-test")._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "Aggregate" not in plan and "Distinct" not in plan and "Deduplicate" not in plan


def test_binge_alerts_foreach_batch(spark, small):
    plays = small.plays_long.limit(3000)
    base = scratch_path(spark, "binge-test")
    table, alerts = f"{base}/plays", f"{base}/alerts"
    run = ST.binge_alerts(table, alerts, min_plays=2)
    half = plays.filter(F.col("listened_at") < "1996-01-01")
    run(half, 0)
    run(plays.exceptAll(half), 1)
    before = spark.read.parquet(alerts).count()
    run(plays.exceptAll(half), 1)  # a retry adds neither plays nor alerts
    assert spark.read.parquet(alerts).count() == before
    got = spark.read.parquet(alerts).groupBy("user_id", "artist_name", "album_name") \
        .agg(F.max("peak_plays").alias("peak_plays"))
    want = B.binges(spark.read.parquet(table).drop("play_date"), min_plays=2)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _verdicts(spark, path):
    return sorted((r.artist_name, r.verdict) for r in ST.current_feedback(spark, path).collect())


def test_feedback_state_batches(spark):
    t0 = dt.datetime(2026, 1, 1)
    hour = dt.timedelta(hours=1)

    def events(*rows):
        return spark.createDataFrame([(LEA, a, v, t0 + h * hour, q) for a, v, h, q in rows],
                                     "user_id long, artist_name string, action string, event_ts timestamp_ntz, seq long")

    path = scratch_path(spark, "fb-test")
    run = ST.feedback_state_batches(path)
    assert ST.current_feedback(spark, path) is None
    b1, b2 = events(("A", "seed", 0, 1), ("B", "block", 0, 2)), events(("a", "block", 1, 3), ("B", "clear", 2, 4))
    run(b1, 0)
    run(b2, 1)
    assert _verdicts(spark, path) == [("a", "block")]
    run(b2, 1)  # a retry
    assert _verdicts(spark, path) == [("a", "block")]
    # an older event arriving late does not bring back the cleared verdict
    run(events(("B", "seed", 1, 5)), 2)
    assert _verdicts(spark, path) == [("a", "block")]
    # of two events at one time the later in the log wins
    run(events(("C", "seed", 3, 7), ("c", "block", 3, 8)), 3)
    assert _verdicts(spark, path) == [("a", "block"), ("c", "block")]
    assert [(r.artist_name, r.verdict) for r in I.feedback_state(b1.unionByName(b2)).collect()] == [("a", "block")]


def test_a_new_checkpoint_goes_on_from_the_newest_state(spark):
    path, landing = scratch_path(spark, "fb-restart"), scratch_path(spark, "fb-landing")
    schema = "user_id long, artist_name string, action string, event_ts timestamp_ntz, seq long"
    for i, name in enumerate("ABC"):
        row = (LEA, name, "seed", dt.datetime(2026, 1, 1 + i), i)
        spark.createDataFrame([row], schema).write.mode("append").parquet(landing)
    for check in ("one", "two"):  # the second run starts again at epoch 0
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        SJ.drain_foreach(stream, ST.feedback_state_batches(path), check)
        spark.createDataFrame([(LEA, "D", "block", dt.datetime(2026, 2, 1), 9)], schema).write.mode("append").parquet(landing)
    assert _verdicts(spark, path) == [("A", "seed"), ("B", "seed"), ("C", "seed"), ("D", "block")]


def test_an_unreadable_table_is_an_error_not_an_empty_one(spark, small, tmp_path):
    bad = tmp_path / "table"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"no parquet")
    plays = small.plays.limit(5).select("user_id", "artist_name", "track_name", "album_name", "listened_at")
    for run in (ST.append_plays_batches(str(bad)), ST.feedback_state_batches(str(bad))):
        with pytest.raises(Exception, match="(?i)parquet|schema"):
            run(plays.withColumn("action", F.lit("seed")).withColumn("event_ts", F.col("listened_at")), 0)
    assert os.listdir(bad) == ["part-0.parquet"]


def test_late_plays_are_not_lost(spark, small):
    """Files newest first; the recomputed cells equal the batch clock."""
    plays = small.plays.select("user_id", "artist_name", "track_name", "album_name", "listened_at").dropDuplicates(
        ["user_id", "track_name", "listened_at"])
    base = scratch_path(spark, "late")
    run = ST.recompute_clock(f"{base}/plays", f"{base}/clock", NY)
    cut = plays.select(F.expr("percentile_approx(unix_micros(to_timestamp(listened_at)), 0.5)")).first()[0]
    late = F.unix_micros(F.to_timestamp("listened_at")) < cut
    run(plays.filter(~late), 0)
    run(plays.filter(late), 1)
    run(plays.filter(late), 1)  # a retry
    got, want = ST.latest_cells(spark, f"{base}/clock"), A.clock(plays, NY, None)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rejected_answers(spark):
    asked = spark.createDataFrame([("A", '{"error":6,"message":"not found"}'), ("B", "<html>"), ("C", '{"toptags":{"tag":[]}}'),
                                   ("D", '{"toptags":{"tag":{"name":"dub","count":3}}}'), ("E", None)], "artist_name string, value string")
    assert sorted(tuple(r) for r in P.parse_artist_tags(asked).collect()) == [("A", "", 0), ("C", "", 0), ("D", "dub", 3)]
    assert sorted(r.artist_name for r in P.rejects(asked).collect()) == ["B", "E"]
    tops = spark.createDataFrame([("A", '{"error":6}'), ("B", "[1]"), ("C", '{"toptracks":{"track":{"name":"x"}}}')],
                                 "artist_name string, value string")
    assert sorted(tuple(r) for r in P.parse_top_tracks(tops).collect()) == [("A", "", 0), ("C", "x", 1)]
    assert P.parse_artist_tags(tops.select("value")).count() == 0  # nobody named: no row
    pages = spark.createDataFrame([('{"recenttracks":{"track":[]}}',), ('{"error":29}',), ('{"recenttracks":',), (None,)], "value string")
    assert P.recent_tracks_rejects(pages).count() == 3


def test_payload_shapes(spark):
    docs = spark.createDataFrame([
        ('{"recenttracks":{"track":[{"name":"Now","artist":{"#text":"X"},"@attr":{"nowplaying":"true"}},'
         '{"name":"T1","artist":{"#text":"X"},"album":{"#text":""},"date":{"uts":"1700000000","#text":"x"}}],'
         '"@attr":{"user":"u","page":"1","totalPages":"3"}}}',),
        ('{"recenttracks":{"track":{"name":"T2","artist":{"#text":"Y"},"album":{"#text":"Alb"},'
         '"date":{"uts":"1700000060","#text":"x"}},"@attr":{"user":"u","page":"2","totalPages":"3"}}}',),
        ('{"recenttracks":{"@attr":{"user":"u","page":"3","totalPages":"3"}}}',),
    ], "value string")
    rows = P.parse_recent_tracks(docs).orderBy("page").collect()
    assert [(r.track_name, r.album_name, r.total_pages) for r in rows] == [("T1", None, 3), ("T2", "Alb", 3)]
    assert rows[0].listened_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    info = spark.createDataFrame([("A", "T", '{"track":{"duration":"238000"}}'),
                                  ("A", "U", '{"error":6,"message":"Track not found"}'),
                                  ("A", "V", '{"track":{"name":"V"}}')],
                                 "artist_name string, track_name string, value string")
    assert [r.duration_ms for r in P.parse_track_info(info).orderBy("track_name").collect()] == [238000, 0, 0]
    tags = spark.createDataFrame([('{"toptags":{"tag":{"name":"rock","count":100},"@attr":{"artist":"A"}}}',),
                                  ('{"toptags":{"tag":[],"@attr":{"artist":"B"}}}',)], "value string")
    assert {tuple(r) for r in P.parse_artist_tags(tags).collect()} == {("A", "rock", 100), ("B", "", 0)}
    sim = spark.createDataFrame([('{"similarartists":{"artist":[{"name":"P","match":"1"},{"name":"Q"}],'
                                  '"@attr":{"artist":"A"}}}',)], "value string")
    assert [tuple(r) for r in P.parse_similar_artists(sim).collect()] == [("A", "P", 1), ("A", "Q", 2)]
    tops = spark.createDataFrame([('{"toptracks":{"track":[{"name":"x"},{"name":"y"}],"@attr":{"artist":"A"}}}',),
                                  ('{"toptracks":{"track":[],"@attr":{"artist":"B"}}}',)], "value string")
    assert {tuple(r) for r in P.parse_top_tracks(tops).collect()} == {("A", "x", 1), ("A", "y", 2), ("B", "", 0)}


def test_live_clock_across_dst_fall_back(spark):
    """New York falls back at 2024-11-03 06:00 UTC (02:00 EDT -> 01:00 EST):
    local time repeats an hour.  The streaming clock, fed one file per
    trigger, must equal the batch clock cell by cell."""
    from cadence.schemas import PLAYS

    base = dt.datetime(2024, 11, 3, 0, 0)
    rows = [(7, "A", f"T{i % 3}", "Alb", base + dt.timedelta(minutes=20 * i)) for i in range(30)]
    plays = spark.createDataFrame(rows, PLAYS).withColumn("play_id", F.monotonically_increasing_id())
    path = scratch_path(spark, "landing-dst")
    for f in range(4):  # 3-hour files covering all 10 hours
        part = plays.filter((F.col("listened_at") >= base + dt.timedelta(hours=3 * f)) &
                            (F.col("listened_at") < base + dt.timedelta(hours=3 * f + 3)))
        TP.render_recent_tracks(part).write.mode("append").text(f"{path}/all")
    users = spark.createDataFrame([(7, "user-7")], "user_id long, username string")
    stream = ST.plays_from_landing(spark, f"{path}/all", users, max_files_per_trigger=1)
    live = SJ.drain(ST.live_clock(stream, NY, delay="2 hours"), "t_dst", mode="update")
    final = live.groupBy("user_id", "day", "part").agg(F.max("plays").alias("plays"))
    batch = A.clock(plays.drop("play_id"), NY, None)
    assert final.exceptAll(batch).count() == 0 and batch.exceptAll(final).count() == 0
    # local night of 2024-11-03 runs 04:00-11:00 UTC (7 hours, the repeated
    # hour included)
    night = [r.plays for r in batch.collect() if r.day == dt.date(2024, 11, 3) and r.part == 0]
    assert night == [sum(1 for _, _, _, _, t in rows
                         if dt.datetime(2024, 11, 3, 4, 0) <= t < dt.datetime(2024, 11, 3, 11, 0))]
