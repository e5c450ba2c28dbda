"""Indexed history search (F3, A19, Q1): a plays table by month with an inverted
index over its names, so that a search reads the days and names that it can hit.

Layout under one path (``write_index``, grown by ``extend_index``):

* ``plays/``: the plays, partitioned by UTC month and sorted by user and time;
* ``names/``: every distinct folded artist, track and album name, once;
* ``grams/``: (gram, name) for the distinct three-character substrings of each name,
  sorted by gram so that a lookup skips row groups.

A name that contains a value of three or more characters holds every gram of
it, so ``ILIKE '%value%'`` becomes an equi-join on the value's rarest gram, verified
once per (value, candidate name) whatever the number of searches that ask for
it.  A search is driven by its text term with the fewest matching names: plays get the
values asked for that their name holds, those without any go no further, and its plays
are found by (user, value).  Years, months, dates and the start and end of a search become
a few spans of UTC days, never a list of days: they prune the folders and row groups of
the scan, and a search without such a term meets its user's plays by day (few days) or
month.  Every play found is still tested by the whole predicate, so results are those
of ``history.matches``.

Values under three characters, wildcards, and values of which even the rarest gram
is in more than ``MAX_NAMES`` names drive nothing: such a search meets the plays
of its user in its days, as without an index.  Case folding may change the length
of a name ('İ' folds to two characters); names and values are folded alike first.

A user with a third of all plays is spread over (user, value) or (user, day) in the
joins of driven and dated searches; the rest are split by AQE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from cadence.operators import history as H
from cadence.operators.common import utc_plays
from cadence.plans.session import bounded_broadcast, materialize, read_table
from cadence.schemas import PLAYS

GRAM = 3
#: Names that may hold a value's rarest gram for the value to drive a search.
MAX_NAMES = 5000
_GRAMS = "gram string, name string, kind string"
_PLAYS = StructType([*PLAYS.fields, StructField("play_month", DateType())])
#: Days up to which a search without a name meets its plays by day, not by month.
FEW_DAYS = 31
_SPANS = "array<struct<first:date,last:date>>"
#: What ``history.tested`` reads of a search.
_ASKED = ["search_id", "f", "tz", "sort", "direction", "start", "end", "error", "artist_pat", "track_pat", "album_pat", "free_pat"]
KINDS = {"artist": "artist_name", "track": "track_name", "album": "album_name"}


def _names(plays: DataFrame) -> DataFrame:
    """(kind, name): the distinct folded names of the plays."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(c).alias("name")) for k, c in KINDS.items()])
    return plays.select(F.inline(pairs)).filter("name <> ''").distinct()


def grams(col: str) -> F.Column:
    """The distinct substrings of ``GRAM`` characters (fewer characters: none)."""
    return F.expr(f"CASE WHEN char_length(`{col}`) >= {GRAM} THEN array_distinct(transform("
                  f"sequence(1, char_length(`{col}`) - {GRAM - 1}), i -> substring(`{col}`, i, {GRAM}))) "
                  "ELSE CAST(array() AS array<string>) END")


def write_index(plays: DataFrame, path: str) -> None:
    """The plays and the index over their names as new tables under ``path``."""
    extend_index(plays, path)


def extend_index(plays: DataFrame, path: str) -> None:
    """Append plays and index the names that are new.

    Names are appended before the plays that bear them, and grams before names: a
    run that was cut off is repeated (new grams and names are found again by an anti
    join), and a reader never sees a play whose name is not indexed.  ``plays`` is
    read twice, so a costly plan is better written first (``materialize``)."""
    spark = plays.sparkSession
    known = read_table(spark, f"{path}/names")
    new = _names(plays)
    if known is not None:
        new = new.join(known, ["kind", "name"], "left_anti")
    new = materialize(new, "new-names")
    pieces = new.select("kind", F.explode(grams("name")).alias("gram"), "name")
    (pieces.repartitionByRange("kind", "gram").sortWithinPartitions("kind", "gram")
           .write.mode("append").partitionBy("kind").parquet(f"{path}/grams"))
    new.hint("rebalance").write.mode("append").parquet(f"{path}/names")
    p = utc_plays(plays, *KINDS.values()).withColumn("play_month", F.trunc("listened_at", "month"))
    (p.hint("rebalance", "play_month").sortWithinPartitions("play_month", "user_id", "listened_at")
      .write.mode("append").partitionBy("play_month").parquet(f"{path}/plays"))


def _terms(searches: DataFrame) -> DataFrame:
    """(_row, field, low): a row per text term without a wildcard."""
    listed = [F.expr(f"transform(filter({k}_pat, t -> t.pat IS NULL), t -> named_struct('field', '{k}', 'low', t.low))")
              for k in (*KINDS, "free")]
    return searches.select("_row", F.inline(F.concat(*listed)))


def _kinds(field: str) -> F.Column:
    """The kinds of name that a term of ``field`` may be in; a free term an artist's or a track's."""
    free = F.array(F.lit("artist"), F.lit("track"))
    return F.when(F.col(field) == "free", free).otherwise(F.array(F.col(field)))


def matching_names(spark: SparkSession, path: str, values: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """(kind, low, n, name): for each distinct (kind, low) of ``values`` that can be looked
    up, the number of names that contain it and each of them (one row with a null name
    if there is none)."""
    index = spark.read.schema(_GRAMS).parquet(f"{path}/grams")
    asked = values.select("kind", "low").distinct().withColumn("gram", F.explode(grams("low")))
    asked = materialize(asked, "asked-grams")
    # names per gram, counted for the grams asked for only
    wanted = bounded_broadcast(asked.select("kind", "gram").distinct(), 200_000)
    counts = index.join(wanted, ["kind", "gram"], "left_semi").groupBy("kind", "gram").agg(F.count("*").alias("n"))
    rarest = (asked.join(counts, ["kind", "gram"], "left")
              .groupBy("kind", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
              .filter(F.col("r.n") <= max_names).select("kind", "low", F.col("r.gram").alias("gram")))
    rarest = materialize(rarest, "rarest-grams")
    held = (index.join(bounded_broadcast(rarest, 200_000), ["kind", "gram"])
            .filter(F.contains("name", "low")).select("kind", "low", "name"))
    found = rarest.select("kind", "low").join(held, ["kind", "low"], "left")
    sizes = found.groupBy("kind", "low").agg(F.count("name").alias("n"))
    return found.join(sizes, ["kind", "low"]).select("kind", "low", "n", "name")


def _spans(first: dt.date, last: dt.date) -> str:
    """SQL for the UTC days of the table that a prepared search can hit, as spans (first, last)
    that have no day in common, NULL when nothing bounds it.  Local dates of a search lie
    within a day of their UTC day.

    Their number does not grow with the days they hold: one for a year or for a start and end,
    one a month where months are asked for, one a day only around single dates."""
    low = f"greatest(DATE '{first}', CAST(`start` AS date))"  # null: skipped
    high = f"least(DATE '{last}', CAST(`end` AS date))"
    year_fits = "(size(f.years) = 0 OR array_contains(f.years, year(d)))"
    month_fits = "(size(f.months) = 0 OR array_contains(f.months, month(d)))"
    near = "array_distinct(flatten(transform(f.dates, d -> sequence(d - 1, d + 1))))"
    dates = (f"transform(filter({near}, d -> d BETWEEN {low} AND {high} AND {year_fits} AND {month_fits}), "
             "d -> named_struct('first', d, 'last', d))")
    years = (f"filter(CASE WHEN size(f.years) > 0 THEN array_distinct(f.years) ELSE sequence(year({low}), year({high})) END, "
             f"y -> y BETWEEN year({low}) AND year({high}))")
    of_years = f"transform({years}, y -> named_struct('first', make_date(y, 1, 1), 'last', make_date(y, 12, 31)))"
    of_months = (f"flatten(transform({years}, y -> transform(array_distinct(f.months), "
                 "m -> named_struct('first', make_date(y, m, 1), 'last', last_day(make_date(y, m, 1))))))")
    whole = f"array(named_struct('first', {low}, 'last', {high}))"
    spans = f"CASE WHEN size(f.months) > 0 THEN {of_months} WHEN size(f.years) > 0 THEN {of_years} ELSE {whole} END"
    clipped = (f"filter(transform({spans}, s -> named_struct('first', greatest(s.first, {low}), 'last', least(s.last, {high}))), "
               "s -> s.first <= s.last)")
    bound = "size(f.dates) > 0 OR size(f.years) > 0 OR size(f.months) > 0 OR `start` IS NOT NULL OR `end` IS NOT NULL"
    return (f"CASE WHEN NOT ({bound}) THEN NULL WHEN {low} > {high} THEN CAST(array() AS {_SPANS}) "
            f"WHEN size(f.dates) > 0 THEN {dates} ELSE {clipped} END")


def _held(steps: list[tuple[dt.date, int]]) -> list[dt.date]:
    """The days inside of any span, from the days at which spans begin (+) and are over (-)."""
    out, open_spans, before = [], 0, None
    for d, step in sorted(steps):
        if open_spans:
            out += [before + dt.timedelta(days=i) for i in range((d - before).days)]
        open_spans, before = open_spans + step, d
    return out


def _ranges(days: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Runs of following days."""
    out: list[tuple[dt.date, dt.date]] = []
    for d in sorted(days):
        if out and (d - out[-1][1]).days == 1:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


def _within(ranges: list[tuple[dt.date, dt.date]]) -> F.Column:
    """Plays of these days: by folder, row group and row."""
    keep = F.lit(False)
    for first, last in ranges:
        months = F.col("play_month").between(F.lit(first.replace(day=1)), F.lit(last))
        after = F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz")
        keep = keep | (months & (F.col("listened_at") >= F.lit(first).cast("timestamp_ntz")) & (F.col("listened_at") < after))
    return keep


def _lowered(plays: DataFrame) -> DataFrame:
    return plays.select("*", *[F.lower(c).alias(f"_{c}_lc") for c in KINDS.values()])


class HistoryIndex:
    """Searches over the tables written by ``write_index``."""

    def __init__(self, spark: SparkSession, path: str, max_names: int = MAX_NAMES):
        self.spark, self.path, self.max_names = spark, path, max_names

    def _plays(self) -> DataFrame:
        return self.spark.read.schema(_PLAYS).parquet(f"{self.path}/plays")

    def _parsed(self, searches: DataFrame) -> DataFrame:
        """All prepared searches, numbered by ``_row``, with ``spans`` (the days they can hit, null:
        any day), written, so that neither their plan nor the parse is run again for every use."""
        span = self._plays().agg(F.min("play_month"), F.last_day(F.max("play_month"))).first()
        # a search costs far more to parse than its size tells AQE: spread over all cores
        spread = searches.repartition(2 * self.spark.sparkContext.defaultParallelism)
        s = H.prepare_searches(spread).withColumn("_row", F.monotonically_increasing_id())
        # without its names, which are in the patterns
        s = s.withColumn("f", F.struct(*[F.col(f"f.{k}") for k in ("years", "months", "dates", "days", "parts")]))
        spans = f"CAST(array() AS {_SPANS})" if span[0] is None else _spans(*span)
        return materialize(s.withColumn("spans", F.expr(spans)), "searches")

    def candidates(self, searches: DataFrame) -> DataFrame:
        """The (search, play) rows that are tested: all that can match, a row each."""
        return self._candidates(self._parsed(searches))

    def _candidates(self, parsed: DataFrame) -> DataFrame:
        # those that can match
        s = parsed.filter("error IS NULL AND (spans IS NULL OR size(spans) > 0)")
        terms = _terms(s)
        asked = terms.select("field", "low").distinct().withColumn("kind", F.explode(_kinds("field")))
        asked = materialize(asked, "asked-values")
        known = materialize(matching_names(self.spark, self.path, asked, self.max_names), "names")
        # a term can drive if every kind of name that it may be in is known
        sizes = known.select("kind", "low", "n").distinct()
        can = (asked.join(sizes, ["kind", "low"], "left").groupBy("field", "low")
               .agg(F.sum("n").alias("n"), F.bool_and(F.col("n").isNotNull()).alias("whole")).filter("whole").drop("whole"))
        drivers = (terms.join(can, ["field", "low"]).repartition("_row").groupBy("_row")
                   .agg(F.min(F.struct("n", "field", "low")).alias("d"))
                   .select("_row", F.col("d.n").alias("_n"), F.col("d.field").alias("_kind"), F.col("d.low").alias("_low")))
        s = s.join(drivers, "_row", "left").filter("_n IS NULL OR _n > 0")
        # how a search meets its plays: by name or not, in all days, some months or few days
        days = F.expr("aggregate(spans, 0, (n, s) -> n + datediff(s.last, s.first) + 1)")
        period = F.when(days <= FEW_DAYS, "day").when(F.col("spans").isNotNull(), "month")
        s = materialize(s.withColumn("_period", period), "driven-searches")
        # the values that drive, and the names that hold them
        lows = s.filter("_low IS NOT NULL").select("_kind", "_period", F.col("_low").alias("low")).distinct()
        lows = lows.withColumn("kind", F.explode(_kinds("_kind")))
        names = materialize(lows.join(known.filter("name IS NOT NULL"), ["kind", "low"]).select(
            "_kind", "_period", "kind", F.col("low").alias("_low"), "name"), "driving-names")
        # at most fifteen shapes, and for each two rows for a day of the table
        steps = F.expr("transform(spans, s -> array(named_struct('d', s.first, 'n', 1), named_struct('d', s.last + 1, 'n', -1)))")
        shapes: dict[tuple, list] = {}
        for r in (s.select("_kind", "_period", F.inline_outer(F.flatten(steps))).groupBy("_kind", "_period", "d")
                  .agg(F.sum("n").alias("n")).collect()):
            shapes.setdefault((r["_kind"], r["_period"]), []).append((r["d"], r["n"]))
        parts = []
        for kind, period in sorted(shapes, key=str):
            here = F.col("_kind").eqNullSafe(F.lit(kind)) & F.col("_period").eqNullSafe(F.lit(period))
            p = self._plays() if period is None else self._plays().filter(_within(_ranges(_held(shapes[kind, period]))))
            p = utc_plays(p, *KINDS.values())
            if kind is None:
                parts.append(self._met(s.filter(here), p, period))
                continue
            for k in ("artist", "track") if kind == "free" else (kind,):
                held = names.filter(here & (F.col("kind") == k)).select("_low", "name")
                named = p.withColumn("name", F.lower(KINDS[k])).join(bounded_broadcast(held, 200_000), "name").drop("name")
                if kind == "free" and k == "track":  # the others are found by their artist
                    named = named.filter("NOT coalesce(contains(lower(artist_name), _low), false)")
                parts.append(_lowered(s.filter(here).select(*_ASKED, "user_id", "_low").join(named, ["user_id", "_low"]).drop("_low")))
        out = parts[0] if parts else self._met(s.limit(0), utc_plays(self._plays(), *KINDS.values()), None)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _met(self, searches: DataFrame, plays: DataFrame, period: str | None) -> DataFrame:
        """(search, play) rows of searches without a name and the plays of their user: joined by
        day or month where the searches have any."""
        plays = _lowered(plays)
        if period is None:
            return searches.select(*_ASKED, "user_id").join(plays, "user_id")
        unit, step = ("DD", "1 DAY") if period == "day" else ("MM", "1 MONTH")
        first = {u: f"trunc(s.{u}, 'MM')" if period == "month" else f"s.{u}" for u in ("first", "last")}
        whole = f"array_distinct(flatten(transform(spans, s -> sequence({first['first']}, {first['last']}, INTERVAL {step}))))"
        when = searches.select("_row", "user_id", F.explode(F.expr(whole)).alias("_when"))
        plays = plays.withColumn("_when", F.expr(f"CAST(date_trunc('{unit}', listened_at) AS date)"))
        # a search is not copied for each of its days
        asked = bounded_broadcast(searches.select("_row", *_ASKED), 100_000)
        return when.join(plays, ["user_id", "_when"]).drop("_when").join(asked, "_row").drop("_row")

    def matches(self, searches: DataFrame) -> DataFrame:
        """As ``history.matches`` over the indexed plays."""
        return H.tested(self.candidates(searches))

    def totals(self, searches: DataFrame) -> DataFrame:
        parsed = self._parsed(searches)
        return H.totals(None, parsed, H.tested(self._candidates(parsed)))

    def page(self, searches: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
        return H.page(None, searches, limit, offset, self.matches(searches))
