"""Fetched spans and their gaps against sets of hours."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.plans.session import scratch_path
from cadence.sources import coverage as C

START = dt.datetime(2024, 1, 30)


def hour(h):
    return START + dt.timedelta(hours=h)


def runs(hours):
    """Runs of following hours as (since, until)."""
    hours, out = sorted(hours), []
    for h in hours:
        if out and out[-1][1] == hour(h):
            out[-1] = (out[-1][0], hour(h + 1))
        else:
            out.append((hour(h), hour(h + 1)))
    return out


spans = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 90), st.integers(-3, 25)), max_size=40)


def table(spark, made):
    return spark.createDataFrame([(u, hour(a), hour(a + n)) for u, a, n in made], C.SPANS)


def fetched(made, user):
    return {h for u, a, n in made if u == user for h in range(a, a + n)}


@settings(max_examples=5, deadline=None)
@given(spans)
def test_union_and_gaps_equal_sets_of_hours(spark, made):
    df = table(spark, made)
    got = sorted(map(tuple, C.united(df).collect()))
    assert got == sorted((u, *r) for u in (1, 2, 3) for r in runs(fetched(made, u)))
    first = spark.createDataFrame([(u, hour(0)) for u in (1, 2, 3)], "user_id long, since timestamp_ntz")
    missing = sorted((r.user_id, r.since, r.until) for r in C.gaps(df, str(hour(70)), first).collect())
    assert missing == sorted((u, *r) for u in (1, 2, 3) for r in runs(set(range(70)) - fetched(made, u)))


def test_gaps_newest_first_and_only_between_spans_by_default(spark):
    df = table(spark, [(1, 0, 2), (1, 5, 2), (1, 10, 1), (2, 3, 4)])
    assert [(r.pos, r.since, r.until) for r in C.gaps(df).orderBy("pos").collect()] == [(1, hour(7), hour(10)), (2, hour(2), hour(5))]


def test_batches_retries_and_merge(spark):
    made = [(1, 10, 5), (1, 0, 3), (2, 4, 4), (1, 3, 2), (2, 20, 1), (1, 14, 6)]
    state = C.Coverage(spark, scratch_path(spark, "coverage"))
    for i in range(3):
        state.add(table(spark, made[i::3]), str(i))
        state.add(table(spark, made[i::3]), str(i))
        if i == 1:
            state.merge()
    assert sorted(map(tuple, state.spans().collect())) == sorted(map(tuple, C.united(table(spark, made)).collect()))
    assert len(state.folders.live()) == 2
    assert C.gaps(table(spark, [])).count() == 0


def test_spans_without_an_end_say_nothing(spark):
    df = spark.createDataFrame([(1, None, hour(3)), (1, hour(3), None), (None, hour(1), hour(2)), (1, hour(5), hour(5))], C.SPANS)
    assert C.united(df).count() == 0
