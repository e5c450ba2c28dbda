"""States that grow by batches: recency sums, the feedback log and the folders under them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadence.operators import taste as TS
from cadence.operators.recency import RecencyState
from cadence.plans.session import scratch_path
from cadence.schemas import PLAYS
from cadence.sources.folders import Folders
from cadence.streaming import streams as ST

START = dt.datetime(2024, 1, 1)


def some_plays(rng, n):
    return [(rng.randrange(3), rng.choice(["Tin Parade", "tin parade", "Ferry", "FERRY", "Plum"]), "t", None,
             START + dt.timedelta(seconds=rng.randrange(400 * 86_400))) for _ in range(n)]


def scores(df):
    return {(r.user_id, r.akey): (r.artist_name, r.plays, round(r.score, 9)) for r in df.collect()}


def test_recency_in_batches_equals_the_sum_over_all_plays(spark):
    rng = random.Random(4)
    rows = some_plays(rng, 300)
    state = RecencyState(spark, scratch_path(spark, "recency"))
    for i in range(4):  # batches overlap in time; the third is empty, the second is repeated
        part = [] if i == 2 else rows[i::4]
        state.add(spark.createDataFrame(part, PLAYS), f"b{i}")
        if i == 1:
            state.add(spark.createDataFrame(part, PLAYS), "b1")
            state.merge()
            state.add(spark.createDataFrame(part, PLAYS), "b1")  # a retry after the merge
    kept = spark.createDataFrame([r for i in (0, 1, 3) for r in rows[i::4]], PLAYS)
    for as_of in ("2024-06-01 12:00:00", "2025-03-01", "2034-01-01"):
        got, expected = scores(state.scores(as_of)), scores(TS.play_scores(kept, as_of))
        assert got.keys() == expected.keys()
        for k in got:
            assert got[k][:2] == expected[k][:2] and got[k][2] == pytest.approx(expected[k][2], rel=1e-9, abs=1e-9)


def test_recency_of_no_plays(spark):
    state = RecencyState(spark, scratch_path(spark, "recency"))
    assert state.scores("2024-01-01").count() == 0


def event(rng, i):
    return (rng.randrange(3), rng.choice(["Ferry", "FERRY", "Plum"]), rng.choice(["seed", "block", "clear"]),
            START + dt.timedelta(hours=rng.randrange(2000)), i)


EVENTS = "user_id long, artist_name string, action string, event_ts timestamp_ntz, seq long"


def latest(events):
    last = {}
    for u, a, action, ts, seq in sorted(events, key=lambda e: (e[3], e[4])):
        last[u, a.lower()] = (u, a, action)
    return sorted(v for v in last.values() if v[2] != "clear")


def test_feedback_log_in_any_order_with_retries_and_merges(spark):
    rng = random.Random(6)
    events = [event(rng, i) for i in range(90)]
    log = ST.FeedbackLog(spark, scratch_path(spark, "feedback-log"))
    for i in range(3):
        part = spark.createDataFrame(events[i::3], EVENTS)
        log.write_batch(part, i)
        log.write_batch(part, i)  # a retry
        if i == 1:
            log.merge()
            log.write_batch(part, i)
        got = sorted((r.user_id, r.artist_name, r.verdict) for r in log.current().collect())
        assert got == latest([e for j in range(i + 1) for e in events[j::3]])
    assert len(log.folders.live()) == 2


def test_merge_drops_old_tombstones_only(spark):
    log = ST.FeedbackLog(spark, scratch_path(spark, "feedback-log"))
    rows = [(1, "Ferry", "clear", START, 0), (1, "Plum", "clear", START + dt.timedelta(days=60), 1), (2, "Ferry", "seed", START, 2)]
    log.write_batch(spark.createDataFrame(rows, EVENTS), 0)
    log.merge(horizon_days=30)
    assert sorted((r.user_id, r.akey, r.action) for r in log.folders.read().collect()) == [(1, "plum", "clear"), (2, "ferry", "seed")]


def test_a_batch_writes_its_own_keys_only(spark):
    log = ST.FeedbackLog(spark, scratch_path(spark, "feedback-log"))
    log.write_batch(spark.createDataFrame([(u, f"Act {i}", "seed", START, i) for u in range(5) for i in range(40)], EVENTS), 0)
    log.write_batch(spark.createDataFrame([(1, "Act 3", "block", START + dt.timedelta(days=1), 0)], EVENTS), 1)
    assert spark.read.parquet(f"{log.folders.path}/data/{log.folders.live()[-1]}").count() == 1
    assert log.current().count() == 200


def test_folders_show_whole_commits_only(spark):
    table = Folders(spark, scratch_path(spark, "folders"), "a long")
    assert table.version() == -1 and table.read().count() == 0
    table.add(spark.range(3).toDF("a"), "x")
    table.write(spark.range(100).toDF("a"), "batch-y")  # cut off before its commit
    assert table.read().count() == 3
    table.add(spark.range(5).toDF("a"), "y")
    before = table.version()
    table.merge(table.read().filter(F.col("a") > 0))
    assert table.read().count() == 6 and table.read(before).count() == 8
    assert table.applied() == ["x", "y"] and table.live() == [f"merged-{before + 1}"]
