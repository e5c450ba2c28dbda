"""Recommendation cache: which users a refresh replaces, bucketed write and read
(V7, S10, S14), plays table (S1), bundle (V10)."""

from pyspark.sql import functions as F

from cadence.operators import recommend as R
from cadence.operators import tags as TG
from cadence.plans.session import scratch_path
from cadence.schemas import ARTIST_TAGS, ARTIST_TOP_TRACKS, FEEDBACK, PLAYS, default_curation
from tests.conftest import AS_OF, LEA, at

CACHE = "user_id long, artist_name string, score double, rank int"


def _corpus(spark):
    tags = spark.createDataFrame([("Copper Lanterns", "folk", 100), ("Velvet Orchard", "dub", 100),
                                  ("Reed Choir", "folk", 100)], ARTIST_TAGS)
    return TG.tag_corpus(TG.clean_tags(tags, *default_curation(spark)))


def test_refresh_keeps_old_lists_only_without_taste(spark, corpus):
    plays = corpus.unionByName(spark.createDataFrame([(2, "Untagged", "T", None, at(1, 1))], PLAYS))
    old = spark.createDataFrame([(2, "Old Pick", 0.5, 1), (LEA, "Stale", 0.1, 1)], CACHE)
    lists = lambda fb: {(r.user_id, r.artist_name) for r in R.refresh(plays, _corpus(spark), fb, old, AS_OF).collect()}
    assert lists(None) == {(LEA, "Reed Choir"), (2, "Old Pick")}
    # a user whose only candidate is blocked gets an empty list, not the old one
    assert lists(spark.createDataFrame([(LEA, "REED CHOIR", "block", None)], FEEDBACK)) == {(2, "Old Pick")}


def _state(spark, path, ids=None):
    return sorted((r.user_id, r.artist_name) for r in R.read_cache(spark, path, ids).collect())


def test_cache_write_replaces_the_given_users_only(spark):
    path = scratch_path(spark, "cache-test")
    first = spark.createDataFrame([(u, f"A{u}", 0.5, 1) for u in range(60)], CACHE)
    R.write_cache(first, path, computed_at=AS_OF, buckets=128)
    assert {r.computed_at for r in R.read_cache(spark, path).collect()} == {AS_OF}
    assert _state(spark, path, list(range(60))) == [(u, f"A{u}") for u in range(60)]
    # user 3 gets a new list, user 4 an empty one: nobody else changes
    users = spark.createDataFrame([(3,), (4,)], "user_id long")
    R.write_cache(spark.createDataFrame([(3, "New", 0.9, 1)], CACHE), path, users)
    want = [(u, f"A{u}" if u != 3 else "New") for u in range(60) if u != 4]
    assert _state(spark, path) == want and _state(spark, path, [3, 4, 5]) == [(3, "New"), (5, "A5")]
    # all lists of all users become empty
    R.write_cache(first.limit(0), path, first)
    assert _state(spark, path) == [] and _state(spark, path, [1]) == []


def test_cache_without_a_list_is_written_and_read(spark):
    path = scratch_path(spark, "cache-empty")
    lists = spark.createDataFrame([(3, "A3", 0.5, 1), (4, "A4", 0.5, 1)], CACHE)
    users = spark.createDataFrame([(4,)], "user_id long")
    R.write_cache(lists.limit(0), path, buckets=128)  # nobody has a candidate: no file is written
    assert _state(spark, path) == [] and _state(spark, path, [3, None]) == []
    R.write_cache(lists.limit(0), path, users)
    assert _state(spark, path, [3, 4]) == []
    R.write_cache(lists, path)
    assert _state(spark, path) == [(3, "A3"), (4, "A4")]


def test_plays_table_prunes_by_date(spark, corpus):
    from cadence.sources.tables import read_plays, write_plays

    path = scratch_path(spark, "plays-test")
    write_plays(corpus, path)
    assert read_plays(spark, path).count() == 14
    recent = read_plays(spark, path, user_id=LEA, since=at(4, 3), until=at(9, 0))
    assert sorted(r.track_name for r in recent.collect()) == ["Ferry", "Ferry"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(play_date" in plan


def test_bundle_has_four_parts(spark, corpus):
    recs = R.refresh(corpus, _corpus(spark), None, as_of=AS_OF)
    tops = spark.createDataFrame([("Reed Choir", "Canon", 1), ("Copper Lanterns", "Beacon", 1)], ARTIST_TOP_TRACKS)
    b = R.bundle(recs, corpus, tops, spark.createDataFrame([], FEEDBACK))
    assert set(b) == {"artists", "songs_from_favorites", "songs_from_new_artists", "feedback"}
    assert [r.track_name for r in b["songs_from_new_artists"].collect()] == ["Canon"]
    assert [r.track_name for r in b["songs_from_favorites"].collect()] == ["Beacon"]
    assert b["feedback"].count() == 0
