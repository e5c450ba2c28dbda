"""Expectations worked out by hand on the corpus of ``conftest`` and small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.functions.timeops import PICKER_DAYS, check_tz, days_norm
from cadence.operators import activity as A
from cadence.operators import genres as G
from cadence.operators import history as H
from cadence.operators import recommend as R
from cadence.operators import tags as TG
from cadence.operators import taste as TS
from cadence.operators import worklists as W
from cadence.schemas import ARTIST_TAGS, FEEDBACK, PLAYS, TRACK_DURATIONS, default_curation
from cadence.sources import ingest as I
from tests.conftest import AS_OF, BASE, LEA, at

NY = "America/New_York"
PARTS = ["night", "morning", "afternoon", "evening"]


def day(n):
    return (BASE + dt.timedelta(days=n)).date()


def runs(df):
    return sorted((r.start_day, r.end_day, r.length_days) for r in df.collect())


UTC_RUNS = [(day(0), day(2), 3), (day(4), day(4), 1), (day(8), day(9), 2)]


def test_streaks_depend_on_the_zone(corpus):
    assert runs(A.streaks(corpus, "UTC")) == UTC_RUNS
    assert runs(A.streaks(corpus, NY)) == [(day(-1), day(4), 6), (day(8), day(8), 1)]


def test_streak_is_current_until_the_day_after(corpus):
    for as_of, current in ((at(9, 23), True), (at(10, 12), True), (at(11, 0), False)):
        got = {r.start_day: r.is_current for r in A.streaks(corpus, "UTC", as_of=as_of).collect()}
        assert got == {day(0): False, day(4): False, day(8): current}


@pytest.mark.parametrize("zone", ["Pacific/Kiritimati", NY])
def test_session_zone_does_not_matter(spark, corpus, zone):
    """Neither for stored wall clocks nor for instants, also in the hour that the
    session's zone repeats."""
    late = spark.createDataFrame([(LEA, "A", "T", None, dt.datetime(2024, 11, 3, 6, 30))], PLAYS)
    plays = corpus.unionByName(late)
    want = {(r.day, r.part): r.plays for r in A.clock(plays, "UTC", None).collect()}
    micros = plays.withColumn("us", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col("listened_at")))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instants = micros.withColumn("listened_at", F.timestamp_micros("us")).drop("us")
        assert dict(instants.dtypes)["listened_at"] == "timestamp"
        for p in (plays, instants):
            assert {(r.day, r.part): r.plays for r in A.clock(p, "UTC", None).collect()} == want
            assert runs(A.streaks(p, "UTC"))[1:] == UTC_RUNS
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_discovery_counts_an_artist_once_whatever_its_casing(corpus):
    assert sum(r.new_artists for r in A.discovery(corpus, "UTC").collect()) == 3


def test_loyalty(corpus):
    got = {r.artist_name: (r.plays, r.active_days, r.days_since_first_play, r.loyalty)
           for r in A.loyalty(corpus, "UTC").collect()}
    assert got == {"Copper Lanterns": (7, 5, 10, 0.5), "Velvet Orchard": (5, 1, 8, 0.13)}


def test_clock_has_every_play_in_a_local_cell(corpus):
    for tz in ("UTC", NY, "Asia/Tokyo"):
        assert sum(r.plays for r in A.clock(corpus, tz, 365, AS_OF).collect()) == 14
    cells = {tz: {(r.day, r.part) for r in A.clock(corpus, tz, 365, AS_OF).collect()} for tz in ("UTC", NY)}
    assert (day(9), 0) in cells["UTC"] and (day(8), 3) in cells[NY] and (day(9), 0) not in cells[NY]


def searches(spark, *queries, tz="UTC"):
    return spark.createDataFrame([(f"q{i}", LEA, q, tz) for i, q in enumerate(queries)],
                                 "search_id string, user_id long, query string, tz string")


def totals(plays, s):
    return [r.total for r in sorted(H.totals(plays, s).collect(), key=lambda r: int(r.search_id[1:]))]


def test_a_clock_cell_counts_what_its_search_finds(spark, corpus):
    for tz in ("UTC", NY, "Asia/Tokyo"):
        cells = A.clock(corpus, tz, None).collect()
        found = totals(corpus, searches(spark, *[f"date:{c.day} part:{PARTS[c.part]}" for c in cells], tz=tz))
        assert found == [c.plays for c in cells]


def test_search_folds_case_and_counts_all_matches(spark, corpus):
    s = searches(spark, "artist:COPPER", "", "%", "orchard", "track:harbour", 'album:"orchard songs"')
    assert totals(corpus, s) == [7, 14, 14, 5, 2, 5]
    pages = [H.page(corpus, s, limit=6, offset=o).filter("search_id = 'q1'").collect() for o in (0, 6, 12)]
    assert [len(p) for p in pages] == [6, 6, 2]
    times = [r.listened_at for p in pages for r in sorted(p, key=lambda r: r.pos)]
    assert times == sorted(times, reverse=True) and len(set(times)) == 14


def test_any_page_size_holds_and_the_pager_clamps(spark, corpus):
    s = searches(spark, "")
    many = corpus.select("user_id", "artist_name", "album_name", "listened_at",
                         F.explode(F.expr("transform(sequence(1, 100), x -> CAST(x AS STRING))")).alias("track_name"))
    assert H.page(many, s, limit=1100, offset=-5).count() == 1100
    deep = H.page(many, s, limit=50, offset=1300).collect()
    assert sorted(r.pos for r in deep) == list(range(1301, 1351))
    assert H.page(corpus, s, limit=0).count() == 1
    assert H.clamp_page(999, -5) == (200, 0) and H.clamp_page(0, 3) == (1, 3)


def test_search_bounds_are_instants_and_errors_stay_with_their_search(spark, corpus):
    rows = [("q0", "2025-03-14T04:00:00+09:00", None), ("q1", "2025-03-13 19:00:00", None), ("q2", None, "2025-03-10T09:30:00-04:00"),
            ("q3", "2025-03-14", None), ("q4", "yesterday", None), ("q5", None, "2025-03-12T06:09:00Z"), ("q6", "", None)]
    s = spark.createDataFrame([(i, LEA, "", a, b) for i, a, b in rows], "search_id string, user_id long, query string, start string, end string")
    assert totals(corpus, s) == [4, 4, 2, 4, 0, 6, 0]
    assert {r.search_id: r.error for r in H.search_errors(s).collect()} == {"q4": "start is no time", "q6": "start is no time"}
    ntz = s.filter("search_id in ('q1', 'q3')").withColumn("start", F.expr("CAST(start AS TIMESTAMP_NTZ)"))
    assert [r.total for r in H.totals(corpus, ntz).collect()] == [4, 4]


def test_long_term_lists_are_matched_to_the_end(spark, corpus):
    six = "copper lanterns undertow tidal"  # tidal is an album: no free term matches it
    assert totals(corpus, searches(spark, "o p e r l a n t", "c o p p e r " + six, "e r n s u n d e r t o w")) == [9, 0, 2]


def test_album_sort_keeps_plays_without_album_at_the_null_end(spark, corpus):
    s = spark.createDataFrame([("a", LEA, "", "album_name", "asc"), ("d", LEA, "", "album_name", "DESC")],
                              "search_id string, user_id long, query string, sort string, direction string")
    got = {"a": [], "d": []}
    for r in sorted(H.page(corpus, s, limit=200).collect(), key=lambda r: r.pos):
        got[r.search_id].append(r.album_name)
    assert got["a"][0] == "Nightfall" and got["a"][-2:] == [None, None] and got["d"][:3] == [None, None, "Tidal"]


def test_top_artists_with_and_without_a_limit_above_sparks_own(spark, corpus):
    assert [r.artist_name for r in W.top_artists(corpus).orderBy("rank").collect()] == [
        "Copper Lanterns", "Velvet Orchard", "Tin Parade"]
    wide = spark.range(2500).selectExpr("1L AS user_id", "concat('a', id) AS artist_name")
    assert W.top_artists(wide, limit=1500).agg(F.max("rank"), F.count("*")).first()[:] == (1500, 1500)


def test_ranges_of_any_length(spark, corpus):
    assert [A.recent_plays(corpus, d, AS_OF).count() for d in (3, 5, 30, 0, None)] == [1, 2, 14, 14, 14]
    old = spark.createDataFrame([(LEA, "A", "T", None, AS_OF - dt.timedelta(days=2999))], PLAYS)
    assert A.recent_plays(corpus.unionByName(old), 3000, AS_OF).count() == 15
    assert sum(r.plays for r in A.clock(corpus.unionByName(old), "UTC", 3000, AS_OF).collect()) == 15
    assert (days_norm(3000), days_norm(0), days_norm(None), days_norm(7)) == (PICKER_DAYS, None, None, 7)


def test_appending_twice_changes_nothing(spark, corpus):
    batch = corpus.withColumn("arrival", F.lit(1))
    twice = batch.unionByName(batch)
    assert I.dedupe_plays(twice, "arrival").count() == 14
    assert I.dedupe_plays(twice, "arrival", existing=corpus).count() == 0
    more = spark.createDataFrame([(LEA, "Tin Parade", "Encore", None, at(11, 1))], corpus.schema).withColumn("arrival", F.lit(2))
    assert [r.track_name for r in I.dedupe_plays(twice.unionByName(more), "arrival", existing=corpus).collect()] == ["Encore"]


def test_the_first_stored_value_of_a_key_stays(spark):
    tags = spark.createDataFrame([("A", "folk", 70, 1), ("A", "folk", 90, 2), ("A", "dub", 5, 2)],
                                 "artist_name string, tag string, weight int, arrival int")
    assert sorted(tuple(r) for r in I.dedupe_tags(tags, "arrival").collect()) == [("A", "dub", 5), ("A", "folk", 70)]
    songs = tags.selectExpr("artist_name", "tag AS track_name", "weight AS rank", "arrival")
    assert sorted(tuple(r) for r in I.dedupe_top_tracks(songs, "arrival", existing=songs.filter("track_name = 'dub'")).collect()) == [
        ("A", "folk", 70)]


def test_work_lists_hold_what_is_not_stored(spark, corpus):
    pairs = corpus.select("artist_name", "track_name").distinct()
    stored = pairs.filter("track_name > 'M'").withColumn("duration_ms", F.lit(1))
    assert {tuple(r) for r in W.missing_durations(corpus, stored).collect()} == {
        ("Copper Lanterns", "Harbour"), ("Copper Lanterns", "Ferry"), ("Velvet Orchard", "Damson")}
    tagged = spark.createDataFrame([("Tin Parade", "", 0), ("COPPER LANTERNS", "folk", 1)], ARTIST_TAGS)
    assert {r.artist_name for r in W.missing_tags(corpus, tagged).collect()} == {"Copper Lanterns", "copper lanterns", "Velvet Orchard"}


def test_month_of_a_play_near_midnight(spark):
    late = spark.createDataFrame([(2, "A", "T", None, dt.datetime(2023, 5, 1, 2, 30))], PLAYS)
    tags = spark.createDataFrame([("A", "dub", 10)], ARTIST_TAGS)
    none = spark.createDataFrame([], TRACK_DURATIONS)
    primary = TG.primary_tag(TG.clean_tags(tags, *default_curation(spark)))
    for tz, month in (("UTC", dt.date(2023, 5, 1)), (NY, dt.date(2023, 4, 1))):
        firsts = [A.report(late, "month", tz), A.listening_time(late, none, "month", tz), G.monthly_summary(late, none, primary, tz),
                  A.discovery(late, tz)]
        assert [[r.month for r in d.collect()] for d in firsts] == [[month]] * 4
        assert [r.period_start for r in G.tag_shift(late, primary, "month", tz).collect()] == [month]


def tag_table(spark, rows):
    return TG.tag_corpus(TG.clean_tags(spark.createDataFrame(rows, ARTIST_TAGS), *default_curation(spark)))


def test_a_user_compared_with_themself(spark, corpus):
    clean = TG.clean_tags(spark.createDataFrame([("Copper Lanterns", "folk", 9), ("Velvet Orchard", "dub", 8)], ARTIST_TAGS),
                          *default_curation(spark))
    pairs = spark.createDataFrame([("p", LEA, LEA)], "pair_id string, user_a long, user_b long")
    s = TS.compatibility(corpus, TG.primary_tag(clean), pairs)["score"].first()
    assert s.score == 100.0 and s.shared_artist_count == 3


def test_recommendations_leave_out_played_seeded_and_blocked_names(spark, corpus):
    table = tag_table(spark, [("COPPER LANTERNS", "folk", 50), ("Reed Choir", "folk", 50), ("Velvet Orchard", "dub", 50),
                              ("Low Bridge", "dub", 50), ("Far Field", "drone", 50), ("Tin Parade", "drone", 50)])
    names = lambda fb: {r.artist_name for r in R.refresh(corpus, table, fb, as_of=AS_OF).collect()}
    assert names(None) == {"Reed Choir", "Low Bridge", "Far Field"}
    assert names(spark.createDataFrame([(LEA, "REED choir", "block", None)], FEEDBACK)) == {"Low Bridge", "Far Field"}
    assert names(spark.createDataFrame([(LEA, "low bridge", "seed", None)], FEEDBACK)) == {"Reed Choir", "Far Field"}


def test_an_artist_of_two_casings_is_one_corpus_row(spark):
    rows = tag_table(spark, [("Reed Choir", "folk", 40), ("REED CHOIR", "folk", 70)]).collect()
    assert len(rows) == 1 and rows[0].weight == 70


def test_unknown_names(spark, corpus):
    tags = spark.createDataFrame([("Low Bridge", "dub", 10)], ARTIST_TAGS)
    names = spark.createDataFrame([("tin parade",), ("LOW BRIDGE",), ("Quiet Mill",)], "name string")
    assert [r.name for r in W.unknown_artists(names, tags, corpus).collect()] == ["Quiet Mill"]
    assert W.unknown_artists(names.limit(0), tags, corpus).count() == 0


def test_curation_rules(spark):
    rules = (spark.createDataFrame([("noise",)], "tag string"), spark.createDataFrame([("d.u.b", "dub")], "alias string, canonical string"),
             spark.createDataFrame([("raga", "chart")], "context_tag string, excluded_tag string"))
    raw = [("P", "Noise ", 9), ("P", " D.U.B", 4), ("P", "dub", 7), ("Q", "", 0), ("Q", "   ", 5), ("R", "raga", 6), ("R", "Chart", 8),
           ("S", "chart", 3)]
    got = {tuple(r) for r in TG.clean_tags(spark.createDataFrame(raw, ARTIST_TAGS), *rules).collect()}
    assert got == {("P", "dub", 7), ("R", "raga", 6), ("S", "chart", 3)}


def test_zone_names():
    for junk in ("Middle/Earth", "", None, 7, "x'; --", "GMT+25", "Factory", "posixrules", f"posix/{NY}", "right/UTC"):
        assert check_tz(junk) == "UTC"
    assert check_tz(NY) == NY and check_tz("Asia/Kolkata") == "Asia/Kolkata"


def test_feedback_keeps_the_latest_and_marks_pending_seeds(spark):
    ev = spark.createDataFrame([(LEA, "Far Field", "seed", at(0, 1)), (LEA, "FAR FIELD", "block", at(0, 2)),
                                (LEA, "Mill", "seed", at(0, 1)), (LEA, "mill", "clear", at(0, 3))],
                               "user_id long, artist_name string, action string, event_ts timestamp_ntz")
    assert [(r.artist_name, r.verdict) for r in I.feedback_state(ev).collect()] == [("FAR FIELD", "block")]
    given = spark.createDataFrame([(LEA, "A", "seed", None), (LEA, "B", "block", None), (LEA, "C", "seed", at(1, 1))], FEEDBACK)
    assert {r.artist_name: r.expanded_at for r in I.mark_seeds_expanded(given, AS_OF).collect()} == {"A": AS_OF, "B": None, "C": at(1, 1)}
    assert [r.artist_name for r in W.pending_seeds(given).collect()] == ["A"]


def test_a_run_with_a_rejected_page_does_not_move_the_mark(spark):
    users = spark.createDataFrame([(1, at(0, 0)), (2, at(0, 0))], "user_id long, last_synced_at timestamp_ntz")
    given = spark.createDataFrame([(1, at(1, 0), True), (2, at(1, 0), True)], "user_id long, started_at timestamp_ntz, completed boolean")
    bad = given.filter("user_id = 2")
    marks = {r.user_id: r.last_synced_at for r in I.advance_sync_marks(users, I.completed_runs(given, bad)).collect()}
    assert marks == {1: at(1, 0), 2: at(0, 0)}


def test_wildcards_and_backslashes_in_search(spark):
    plays = spark.createDataFrame([(LEA, "NO\\W", "A_b", None, at(0, 1)), (LEA, "NOxW", "AZb", None, at(0, 2)),
                                   (LEA, "90% Rain", "Song", None, at(0, 3))], PLAYS)
    # a backslash is literal; '_' and '%' stay wildcards
    assert totals(plays, searches(spark, "artist:NO\\W", "track:A_b", "90%", "artist:no\\w%")) == [1, 2, 1, 1]
