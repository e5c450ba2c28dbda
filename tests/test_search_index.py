"""Indexed search against the search that tests every play of a user."""

import datetime as dt
import io
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cadence.operators import history as H
from cadence.operators import search_index as SI
from cadence.plans.session import scratch_path
from cadence.schemas import PLAYS

ARTISTS = ["Copper Lanterns", "COPPER lanterns", "Tin Parade", "İstanbul", "ab", "50% Off", "Under_score", "Zoë & the Zs"]
TRACKS = ["Harbour", "Signal fire", "Fire", "ab", "Parade of tin", "ﬁre", "x"]
ALBUMS = ["Tidal", "Nightfall", None, "", "Tin"]
WORDS = ["copper", "fire", "Tin", "parade", "tin", "ab", "50%", "er_s", "istanbul", "İst", "zoë", "nothing", "lan", "x", "ﬁr"]
FIELDS = ["", "", "artist:", "track:", "album:"]
WHEN = ["", "", "", "year:2024", "year:2025", "month:3", "date:2024-12-31", "date:20250301", "day:monday", "part:evening", "year:1999",
        "year:2024 year:2025", "date:2025-01-01 year:2024"]
ZONES = ["UTC", "America/New_York", "Pacific/Kiritimati", "Nowhere/Land"]
BOUNDS = [None, None, None, "2024-12-31T18:00:00Z", "2025-02-10", "some day"]


def random_plays(rng, n, users=3):
    start = dt.datetime(2024, 12, 1)
    return [(rng.randrange(users), rng.choice(ARTISTS), rng.choice(TRACKS), rng.choice(ALBUMS),
             start + dt.timedelta(minutes=rng.randrange(130 * 24 * 60))) for _ in range(n)]


def random_searches(rng, n, users=3):
    out = []
    for i in range(n):
        words = " ".join(f'{rng.choice(FIELDS)}"{rng.choice(WORDS)}"' for _ in range(rng.choice([0, 1, 1, 2])))
        out.append((f"s{i}", rng.randrange(users + 1), f"{words} {rng.choice(WHEN)}", rng.choice(ZONES), rng.choice(BOUNDS), rng.choice(BOUNDS)))
    return out


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    plays = spark.createDataFrame(random_plays(rng, 600), PLAYS)
    searches = spark.createDataFrame(random_searches(rng, 80), "search_id string, user_id long, query string, tz string, start string, end string")
    path = scratch_path(spark, "index-test")
    SI.write_index(plays.filter("user_id = 0"), path)
    SI.extend_index(plays.filter("user_id > 0"), path)
    return plays, searches, path


@pytest.mark.parametrize("max_names", [5000, 0])
def test_same_rows_as_testing_every_play(spark, tables, max_names):
    plays, searches, path = tables
    index = SI.HistoryIndex(spark, path, max_names)
    expected = rows(H.matches(plays, searches))
    assert len(expected) > 200
    assert rows(index.matches(searches)) == expected


def test_names_and_grams_are_stored_once(spark, tables):
    plays, _, path = tables
    names = spark.read.parquet(f"{path}/names")
    kinds = {"artist": {a.lower() for a in ARTISTS}, "track": {t.lower() for t in TRACKS}, "album": {a.lower() for a in ALBUMS if a}}
    assert sorted(map(tuple, names.select("kind", "name").collect())) == sorted((k, n) for k, ns in kinds.items() for n in ns)
    got = sorted(map(tuple, spark.read.parquet(f"{path}/grams").select("kind", "gram", "name").collect()))
    assert got == sorted((k, g, n) for k, ns in kinds.items() for n in ns for g in {n[i:i + 3] for i in range(len(n) - 2)})


def test_matching_names(spark, tables):
    values = spark.createDataFrame([("artist", "copper"), ("track", "fire"), ("track", "ab"), ("album", "zzz"), ("artist", "copper")], "kind string, low string")
    found = {(r.kind, r.low, r.n, r.name) for r in SI.matching_names(spark, tables[2], values).collect()}
    assert found == {("artist", "copper", 1, "copper lanterns"), ("track", "fire", 2, "fire"), ("track", "fire", 2, "signal fire"),
                     ("album", "zzz", 0, None)}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_days_prune_the_scan_and_are_join_keys(spark, tables):
    search = spark.createDataFrame([("a", 1, "year:2025 fire", "UTC"), ("b", 2, "date:2025-01-10", "UTC")], "search_id string, user_id long, query string, tz string")
    text = plan(SI.HistoryIndex(spark, tables[2]).matches(search))
    scans = re.findall(r"PartitionFilters: \[.*play_month.*", text)
    assert scans and all("2025-01" in s for s in scans)
    assert "GreaterThanOrEqual(listened_at,2025-01-09T00:00)" in text and "LessThan(listened_at,2025-01-12T00:00)" in text
    keys = "".join(re.findall(r"Left keys.*", text))
    assert "_when" in keys and "name" in keys


def test_selective_searches_test_few_plays(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    plays = spark.createDataFrame([(rng.randrange(4), f"Artist number {rng.randrange(200)}", f"Track {rng.randrange(300)}", "Album",
                                    start + dt.timedelta(hours=rng.randrange(24 * 300))) for _ in range(6000)], PLAYS)
    path = scratch_path(spark, "index-test")
    SI.write_index(plays, path)
    queries = ['artist:"number 17"', "date:2024-03-05", '"track 29" month:5', "year:2024 artist:\"number 5\"", "nowhere"]
    searches = spark.createDataFrame([(f"{u}-{i}", u, q) for u in range(4) for i, q in enumerate(queries)], "search_id string, user_id long, query string")
    index = SI.HistoryIndex(spark, path)
    every = plays.join(searches, "user_id").count()
    tested = index.candidates(searches).count()
    assert tested < every / 10
    assert rows(index.matches(searches)) == rows(H.matches(plays, searches))


def test_each_search_meets_a_play_once(spark, tables):
    index = SI.HistoryIndex(spark, tables[2])
    search = spark.createDataFrame([("a", 1, "tin")], "search_id string, user_id long, query string")
    met = index.candidates(search)
    plays = tables[0].filter("user_id = 1 AND (lower(artist_name) LIKE '%tin%' OR lower(track_name) LIKE '%tin%')")
    assert met.count() == plays.count()


def test_empty_tables(spark):
    path = scratch_path(spark, "index-test")
    SI.write_index(spark.createDataFrame([], PLAYS), path)
    index = SI.HistoryIndex(spark, path)
    one = spark.createDataFrame([("a", 1, "copper year:2024")], "search_id string, user_id long, query string")
    assert index.matches(one).count() == 0 and index.matches(one.limit(0)).count() == 0
    assert [tuple(r) for r in index.totals(one).collect()] == [("a", 0)]


def test_ranges_join_following_days():
    days = [dt.date(2024, 2, d) for d in (28, 29, 5)] + [dt.date(2024, 3, 1)]
    assert SI._ranges(days) == [(dt.date(2024, 2, 5),) * 2, (dt.date(2024, 2, 28), dt.date(2024, 3, 1))]


def test_grams_of_short_and_repeating_names(spark):
    df = spark.createDataFrame([("ab",), ("",), ("aaaa",), ("abcd",), ("é😀b",), (None,)], "v string")
    assert [sorted(r[0]) for r in df.select(SI.grams("v")).collect()] == [[], [], ["aaa"], ["abc", "bcd"], ["é😀b"], []]


def test_spans_hold_the_days_that_a_search_can_hit(spark):
    first, last = dt.date(2023, 11, 1), dt.date(2025, 2, 28)
    queries = ["", "year:2024", "year:2024 year:2024 year:2025 year:9999 year:1", "month:2", "month:2 month:12 month:feb", "year:2025 month:2",
               "year:1999", "date:2024-02-29", "date:2024-02-29 date:20240301 date:2023-10-31", "date:2024-12-31 year:2025", "date:2024-03-01 month:2",
               "date:2030-01-01", "day:monday copper"]
    bounds = [(None, None), ("2024-02-28T23:30:00-02:00", None), (None, "2023-12-24"), ("2024-01-31", "2024-02-01"), ("2024-02-01", "2024-01-31"),
              ("2030-01-01", None), (None, "1999-01-01"), ("0001-01-01", "9999-12-31")]
    rows = [(f"{i}-{j}", 1, q, a, b) for i, q in enumerate(queries) for j, (a, b) in enumerate(bounds)]
    searches = H.prepare_searches(spark.createDataFrame(rows, "search_id string, user_id long, query string, start string, end string"))
    every = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    for r in searches.withColumn("spans", F.expr(SI._spans(first, last))).collect():
        f, start, end = r.f, r.start and r.start.date(), r.end and r.end.date()
        near = {d + dt.timedelta(days=i) for d in f.dates for i in (-1, 0, 1)}
        want = [d for d in every if (not f.dates or d in near) and (not f.years or d.year in f.years) and (not f.months or d.month in f.months)
                and (start is None or d >= start) and (end is None or d <= end)]
        if not (f.dates or f.years or f.months or start or end):
            assert r.spans is None
            continue
        got = [s.first + dt.timedelta(days=i) for s in r.spans for i in range((s.last - s.first).days + 1)]
        assert sorted(got) == want, (r.search_id, r.spans)


def test_held_days_are_those_inside_of_a_span():
    a = dt.date(2024, 2, 27)
    on = [a + dt.timedelta(days=i) for i in range(9)]
    assert SI._held([(on[5], 1), (on[3], -1), (on[0], 2), (on[2], -1), (on[6], -1)]) == [*on[:3], on[5]]
    assert SI._held([]) == []


def test_no_search_is_written_with_a_list_of_days(spark, tables, monkeypatch):
    written = []

    def kept(df, name):
        written.append(materialize(df, name))
        return written[-1]

    materialize = SI.materialize
    monkeypatch.setattr(SI, "materialize", kept)
    queries = ["year:2024 year:2025 fire", "year:2024", "month:3 copper", "date:2025-01-10 date:2024-12-20"]
    searches = spark.createDataFrame([(f"s{i}", i % 3, queries[i % 4]) for i in range(40)], "search_id string, user_id long, query string")
    assert SI.HistoryIndex(spark, tables[2]).totals(searches).agg(F.sum("total")).first()[0] > 0
    lists = [(df, c) for df in written for c, kind in df.dtypes if kind.startswith("array") and "date" in kind]
    assert lists and all(df.agg(F.max(F.size(c))).first()[0] <= 6 for df, c in lists)  # three days around a date


def test_searches_are_read_and_parsed_once_on_all_cores(spark, tables):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(query):
        runs.add(1)
        return query

    searches = spark.createDataFrame([(f"s{i}", i % 3, f"year:2025 fire {i}") for i in range(30)], "search_id string, user_id long, query string")
    index = SI.HistoryIndex(spark, tables[2])
    assert index.totals(searches.coalesce(1).withColumn("query", told("query"))).count() == 30
    assert runs.value == 30
    assert index._parsed(searches.coalesce(1)).rdd.getNumPartitions() > 1


def test_months_alone_prune_the_scan(spark, tables):
    search = spark.createDataFrame([("a", 1, "month:2 fire")], "search_id string, user_id long, query string")
    index = SI.HistoryIndex(spark, tables[2])
    scans = re.findall(r"PartitionFilters: \[.*play_month.*", plan(index.matches(search)))
    assert scans and all("2025-02" in s for s in scans)
    assert rows(index.matches(search)) == rows(H.matches(tables[0], search)) != []


def test_plays_without_a_name_asked_for_are_dropped_before_the_user_join(spark, tables):
    search = spark.createDataFrame([("a", 1, 'track:"signal"')], "search_id string, user_id long, query string")
    text = plan(SI.HistoryIndex(spark, tables[2]).matches(search))
    assert re.search(r"Left keys[^\n]*name", text) and re.search(r"keys[^\n]*user_id[^\n]*_low", text)


def test_names_too_many_to_broadcast(spark, tables, monkeypatch):
    plays, searches, path = tables
    monkeypatch.setattr(SI, "bounded_broadcast", lambda df, *_: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(SI.HistoryIndex(spark, path).matches(searches)) == rows(H.matches(plays, searches))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_searches_that_share_an_id_are_searched_each_for_itself(spark, tables):
    rows_ = [("a", 1, "copper"), ("a", 1, "fire"), ("a", 2, "date:2025-01-10"), (None, 1, "year:2025"), ("b", 1, "%")]
    searches = spark.createDataFrame(rows_, "search_id string, user_id long, query string")
    index = SI.HistoryIndex(spark, tables[2])
    assert rows(index.matches(searches)) == rows(H.matches(tables[0], searches)) != []
    assert rows(index.totals(searches)) == rows(H.totals(tables[0], searches))
