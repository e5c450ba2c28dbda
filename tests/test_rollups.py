"""Bitmap states, the clustered plays table and the ledger of late plays."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cadence.operators import activity as A
from cadence.operators.distinct_state import DistinctState, numbered
from cadence.plans.session import materialize, scratch_path
from cadence.sources import testpages as TP
from cadence.sources.clustered import ClusteredPlays
from cadence.streaming import jobs as SJ
from cadence.streaming import streams as ST
from cadence.streaming.late import LateLedger

NY = "America/New_York"


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- bitmaps --------------------------------------------------------------------

def test_reports_roll_up_from_batches(spark, small):
    plays = small.plays_long.filter("user_id % 3 = 0")
    state = DistinctState(spark, scratch_path(spark, "distinct-test"), NY)
    part = F.expr("abs(hash(track_name, listened_at)) % 3")
    for i in (0, 1, 1):
        state.add(plays.filter(part == i), f"b{i}")
    state.merge()
    state.add(plays.filter(part == 2), "b2")
    for period in ("week", "month"):
        got = state.report(period)
        assert same(A.report(plays, period, NY), got)
        assert "Expand" not in plan(got)
    p = plays.withColumn("month", F.trunc(ST.local_date("listened_at", NY), "month"))
    counts = [F.count(F.lit(1)).alias("plays"), F.countDistinct("track_name").alias("distinct_tracks"),
              F.countDistinct(F.lower("artist_name")).alias("distinct_artists")]
    assert same(p.groupBy("user_id", F.year("month").alias("year")).agg(*counts), state.years())
    assert same(p.groupBy("user_id").agg(*counts), state.all_time())


def test_numbers_are_dense_within_a_user_and_never_change(spark):
    known = spark.createDataFrame([(1, "track", "b", 1), (1, "track", "d", 2)], "user_id long, kind string, name string, id long")
    names = spark.createDataFrame([(1, "track", n) for n in "abcdeaa"] + [(1, "artist", "a"), (2, "track", "a")] +
                                  [(3, "track", f"n{i}") for i in range(500)], "user_id long, kind string, name string")
    got = {}
    for r in numbered(names, known).collect():
        got.setdefault((r.user_id, r.kind), {})[r.name] = r.id
    assert set(got[1, "track"]) == set("ace") and sorted(got[1, "track"].values()) == [3, 4, 5]
    assert got[1, "artist"] == {"a": 1} and got[2, "track"] == {"a": 1}
    assert sorted(got[3, "track"].values()) == list(range(1, 501))


def test_more_names_than_one_bitmap_holds(spark):
    plays = spark.range(70_000).select(F.lit(7).cast("long").alias("user_id"), F.lit("A").alias("artist_name"),
                                       F.concat(F.lit("t"), F.col("id")).alias("track_name"), F.lit(None).cast("string").alias("album_name"),
                                       F.expr("TIMESTAMP_NTZ '2024-02-26 00:00:00' + make_dt_interval(id % 7)").alias("listened_at"))
    state = DistinctState(spark, scratch_path(spark, "distinct-many"))
    state.add(plays, "a")
    assert [tuple(r) for r in state.report("week").collect()] == [(7, dt.date(2024, 2, 26), 70_000, 70_000, 1, None)]
    assert [r.distinct_tracks for r in state.report("month").orderBy("month").collect()] == [40_000, 30_000]


def test_empty_batches_and_null_names(spark, small):
    state = DistinctState(spark, scratch_path(spark, "distinct-empty"))
    state.add(small.plays.limit(0), "none")
    assert state.report().count() == 0
    odd = small.plays.limit(1).withColumn("track_name", F.lit(None).cast("string"))
    state.add(odd, "odd")
    assert [(r.plays, r.distinct_tracks, r.distinct_artists) for r in state.report().collect()] == [(1, 0, 1)]


def test_the_state_of_many_small_cells_is_small(spark):
    """A cell of a few names takes a few longs, not a whole bitmap of 4 KB."""
    from cadence.operators.distinct_state import _named, cell_counts, cells
    from cadence.schemas import PLAYS
    rows = [(u, f"A{u % 3}", f"T{i}", "Alb", dt.datetime(2024, 1 + i % 3, 5)) for u in range(50) for i in range(130)]
    plays = spark.createDataFrame(rows, PLAYS)
    counts = cell_counts(plays, "UTC")
    names = numbered(_named(counts), spark.createDataFrame([], "user_id bigint, kind string, name string, id bigint"))
    state = cells(counts, names).filter("kind <> 'plays'")
    assert dict(state.dtypes)["bits"] == "bigint"
    # 130 tracks numbered from 1 lie in three words, an artist in one; three cells a user
    assert state.count() <= 50 * 3 * (3 + 1)
    assert state.groupBy("kind").agg(F.sum(F.bit_count("bits")).alias("n")).orderBy("kind").collect()[1].n == 50 * 130


# --- plays by user ----------------------------------------------------------------

def test_clustered_plays_need_no_exchange(spark, small):
    table = ClusteredPlays(spark, scratch_path(spark, "clustered"), buckets=8)
    plays = materialize(small.plays_long.dropDuplicates(["user_id", "track_name", "listened_at"]), "plays")
    table.write(plays)
    cold, hot = table.parts()
    for operator in (lambda p: A.streaks(p, NY), lambda p: A.discovery(p, NY), A.landed_counts):
        assert "Exchange" in plan(operator(plays))
        assert "Exchange hashpartitioning" not in plan(operator(cold))
        assert same(operator(plays), table.apply(operator))
    pruned = table.parts(since="1995-03-10", until="1995-06-01")[0]
    assert "month" in plan(pruned).split("PartitionFilters")[1][:200]
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("1995-03-10", "1995-06-01"))
    assert same(plays.filter((F.col("listened_at") >= since) & (F.col("listened_at") < until)), table.read("1995-03-10", "1995-06-01"))


def test_a_hot_user_is_kept_apart_and_appends_are_compacted(spark, small):
    plays = small.plays_long.filter("year(listened_at) = 1997").withColumn("user_id", F.when(F.expr("abs(hash(track_name)) % 3 = 0"), F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    plays = materialize(plays.dropDuplicates(["user_id", "track_name", "listened_at"]), "plays")
    early = F.expr("abs(hash(track_name, listened_at)) % 2 = 0")
    table = ClusteredPlays(spark, scratch_path(spark, "clustered-hot"), buckets=8)
    table.append(plays.filter(early))
    cold, hot = table.parts()
    assert {r.user_id for r in hot.select("user_id").distinct().collect()} == {-1}
    assert cold.filter("user_id = -1").count() == 0
    late = plays.filter(~early | F.expr("user_id % 2 = 0"))  # partly stored already
    table.append(late)
    table.append(late)
    assert same(plays, table.read())
    before = [len(p.inputFiles()) for p in table.parts()]
    old = table.read()
    table.compact()
    assert same(plays, table.read()) and old.count() == plays.count()
    cold, hot = table.parts()
    assert len(cold.inputFiles()) < before[0]
    top = lambda p: A.loyalty(p, "UTC", min_plays=2)
    assert same(top(plays), table.apply(top))


def test_an_append_of_many_tasks_makes_one_file_a_bucket_and_month(spark, small):
    plays = materialize(small.plays_long.filter("year(listened_at) = 1996").dropDuplicates(["user_id", "track_name", "listened_at"]), "plays")
    table = ClusteredPlays(spark, scratch_path(spark, "clustered-files"), buckets=4)
    early = F.expr("abs(hash(track_name, listened_at)) % 2 = 0")
    table.write(plays.filter(early))
    once = len(table.parts()[0].inputFiles())
    table.append(plays.filter(~early).repartition(12))
    assert once <= 4 * 12 and len(table.parts()[0].inputFiles()) <= 2 * 4 * 12
    assert same(plays, table.read())


# --- late plays -------------------------------------------------------------------

def brute_ledger(batches, delay):
    """{key: (row, batch, late)} of the plays of batches in order."""
    kept, newest = {}, None
    for i, rows in enumerate(batches):
        mark = None if newest is None else newest - delay
        for r in sorted(rows, key=lambda r: (r[1], r[3] is not None, r[3] or "")):
            kept.setdefault((r[0], r[2], r[4]), (r, i, mark is not None and r[4] <= mark))
        newest = max([r[4] for r in rows] + ([newest] if newest else []), default=None)
    return kept


def test_ledger_equals_brute_force(spark):
    rng = random.Random(4)
    start, delay = dt.datetime(2024, 3, 1), dt.timedelta(hours=30)
    sent = [(rng.randrange(3), rng.choice("AB"), rng.choice("xyz"), rng.choice([None, "L"]), start + dt.timedelta(hours=rng.randrange(200)))
            for _ in range(300)]
    batches = [[] for _ in range(6)]
    for r in sent:
        i = int((r[4] - start).total_seconds() // 3600 // 40)
        batches[min(5, i + rng.choice([0, 0, 0, 1, 2]))].append(r)
    batches[4] += batches[1][:20]  # replays
    batches[3] = []
    schema = "user_id long, artist_name string, track_name string, album_name string, listened_at timestamp_ntz"
    ledger = LateLedger(spark, scratch_path(spark, "late-test"), delay)
    for i, rows in enumerate(batches):
        ledger.write_batch(spark.createDataFrame(rows, schema), i)
        if i == 2:  # a retry, whole and after a cut between its two tables
            ledger.write_batch(spark.createDataFrame(rows, schema), i)
    want = brute_ledger(batches, delay).values()
    cols = ["user_id", "artist_name", "track_name", "album_name", "listened_at"]

    def rows(df):
        return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    assert rows(ledger.ledger()) == sorted((r for r, _, late in want if late), key=repr) != []
    assert rows(ledger.counted()) == sorted((r for r, _, late in want if not late), key=repr)
    per = {int(r.batch.split("-")[-1]): r for r in ledger.batches().collect()}
    for i, b in enumerate(batches):
        mine = [late for _, at, late in want if at == i]
        assert (per[i].sent, per[i].counted, per[i].late) == (len(b), mine.count(False), mine.count(True))
        assert per[i].replayed == len(b) - len(mine)
    cells = A.clock(ledger.counted().unionByName(ledger.ledger()).drop("batch"), NY, None)
    fixed = ledger.corrections(NY)
    assert fixed.select("user_id", "day", "part", "plays").exceptAll(cells).count() == 0
    assert fixed.agg(F.sum(F.col("plays") - F.col("counted"))).first()[0] == ledger.ledger().count()


def test_nothing_is_lost_in_a_stream(spark, small):
    base = scratch_path(spark, "late-stream")
    plays = small.plays.withColumn("file", F.expr("CAST(play_id % 4 AS INT)")).drop("play_id")
    TP.land_parquet(plays, f"{base}/landing", "file")
    stream = (spark.readStream.schema("user_id long, artist_name string, track_name string, album_name string, listened_at timestamp_ntz, file int")
              .option("maxFilesPerTrigger", 1).parquet(f"{base}/landing"))
    ledger = LateLedger(spark, f"{base}/ledger", dt.timedelta(days=5))
    SJ.drain_foreach(stream, ledger.write_batch, "late")
    assert ledger.ledger().count() > 0 and ledger.batches().count() >= 4
    whole = ledger.counted().unionByName(ledger.ledger()).drop("batch")
    key = ["user_id", "track_name", "listened_at"]
    assert same(small.plays.select(key).distinct(), whole.select(key))
