"""Play-history search, paging and totals for a table of searches (F3, Q1,
Q2, A19).

``searches`` has (search_id, user_id, query) and optionally tz, sort,
direction, start, end.  Each search is joined to its user's plays (equi-join
on user_id) and filtered by the parsed query; the page and the total come
from the same predicate, so "of N" always agrees with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.search import parse_searches, sql_str
from cadence.functions.timeops import local_date_sql, part_of_day_sql, valid_tz_col, weekday_sql
from cadence.operators.common import top_k, utc_plays

SORT_COLUMNS = ["listened_at", "artist_name", "track_name", "album_name"]
# Fixed value: the largest page that a pager offers.
MAX_PAGE = 200
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def prepare_searches(searches: DataFrame) -> DataFrame:
    """Parse queries, validate zones (unknown -> UTC), whitelist sort
    columns and directions, and build the LIKE patterns once per search."""
    cols = set(searches.columns)

    def opt(name, default):
        return F.col(name) if name in cols else F.lit(default)

    sort = opt("sort", "listened_at")
    direction = F.lower(opt("direction", "desc"))
    base = searches.select("search_id", "user_id", "query",
                           valid_tz_col("tz").alias("tz") if "tz" in cols else F.lit("UTC").alias("tz"),
                           sort.alias("sort"), direction.alias("direction"),
                           opt("start", None).alias("start"), opt("end", None).alias("end"))
    s = parse_searches(base).select(
        "search_id", "user_id", "f", "tz",
        F.when(F.col("sort").isin(*SORT_COLUMNS), F.col("sort")).otherwise(F.lit("listened_at")).alias("sort"),
        F.when(F.col("direction") == "asc", F.lit("asc")).otherwise(F.lit("desc")).alias("direction"),
        F.expr(_instant_sql(base, "start")).alias("start"), F.expr(_instant_sql(base, "end")).alias("end"),
        F.when(F.expr(f"`start` IS NOT NULL AND {_instant_sql(base, 'start')} IS NULL"), "start is no time")
         .when(F.expr(f"`end` IS NOT NULL AND {_instant_sql(base, 'end')} IS NULL"), "end is no time").alias("error"))
    # per value: (lower-cased value, LIKE pattern or NULL when the value has
    # no wildcard, in which case a substring test is exactly the ILIKE); the
    # pattern doubles backslashes so they match literally
    bs, bs2 = sql_str(r"\\"), sql_str(r"\\\\")  # regex \\ -> replacement \\\\
    term = ("v -> named_struct('low', lower(v), 'pat', CASE WHEN contains(v, '%') OR contains(v, '_') "
            f"THEN concat('%', regexp_replace(v, {bs}, {bs2}), '%') END)")
    pats = [F.expr(f"transform(f.{k}, {term})").alias(f"{k}_pat") for k in ("artist", "track", "album", "free")]
    return s.select("*", *pats)


def _instant_sql(df: DataFrame, name: str) -> str:
    """A search bound as UTC wall clock: an instant, or text with a zone offset, by
    its microseconds; a wall clock without offset is UTC; other text is NULL."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return f"`{name}`"
    at_epoch = f"timestampadd(MICROSECOND, unix_micros({{}}), {_EPOCH})"
    if kind == "timestamp":
        return at_epoch.format(f"`{name}`")
    offset = sql_str(r"[Tt ]\d{1,2}(:\d{2}){0,2}(\.\d+)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)\s*$")
    instant = at_epoch.format(f"try_cast(`{name}` AS TIMESTAMP)")
    return f"(CASE WHEN `{name}` RLIKE {offset} THEN {instant} ELSE try_cast(`{name}` AS TIMESTAMP_NTZ) END)"


def search_errors(searches: DataFrame) -> DataFrame:
    """(search_id, error) of the searches with a bound that is no time; such a search
    matches nothing and does not touch the others."""
    return prepare_searches(searches).filter("error IS NOT NULL").select("search_id", "error")


UNROLL = 4


def _ilike_sql(col: str, x: str) -> str:
    """``col ILIKE '%v%'`` for a parsed term ``x``: a plain substring test on
    the play's lower-cased field (computed once per play, before the join)
    unless the value carries a wildcard (then a LIKE with its pattern)."""
    return f"(CASE WHEN {x}.pat IS NULL THEN contains(`_{col}_lc`, {x}.low) ELSE `{col}` ILIKE {x}.pat END)"


def _unless_sql(skip: str, test: str) -> str:
    """``skip OR test`` written as CASE: subexpression elimination never
    hoists what sits inside a CASE branch, so ``test`` (a time-zone
    conversion, a substring test) is only evaluated when ``skip`` is false."""
    return f"(CASE WHEN {skip} THEN true ELSE {test} END)"


def _all_sql(arr: str, pred) -> str:
    """``forall(arr, pred)``, true for an empty list.  Higher-order functions
    run interpreted, outside whole-stage codegen, so the first ``UNROLL``
    terms are tested positionally in generated code and only longer lists
    fall back to ``forall`` over the rest."""
    parts = [_unless_sql(f"size({arr}) <= {i}", pred(f"get({arr}, {i})")) for i in range(UNROLL)]
    rest = f"forall(slice({arr}, {UNROLL + 1}, size({arr})), x -> {pred('x')})"
    parts.append(_unless_sql(f"size({arr}) <= {UNROLL}", rest))
    return " AND ".join(parts)


def _any_sql(arr: str, value: str) -> str:
    return _unless_sql(f"size({arr}) = 0", f"array_contains({arr}, {value})")


def match_predicate() -> str:
    """F3 as one SQL boolean expression over the joined (search, play) row."""
    ts, tz = "listened_at", "tz"
    conds = [
        _all_sql("artist_pat", lambda x: _ilike_sql("artist_name", x)),
        _all_sql("track_pat", lambda x: _ilike_sql("track_name", x)),
        _all_sql("album_pat", lambda x: _ilike_sql("album_name", x)),
        _all_sql("free_pat", lambda x: f"({_ilike_sql('artist_name', x)} OR {_ilike_sql('track_name', x)})"),
        _any_sql("f.years", f"year({ts})"),
        _any_sql("f.months", f"month({ts})"),
        _any_sql("f.dates", local_date_sql(ts, tz)),
        _any_sql("f.days", weekday_sql(ts, tz)),
        _any_sql("f.parts", part_of_day_sql(ts, tz)),
        "error IS NULL",
        _unless_sql("`start` IS NULL", f"{ts} >= `start`"),
        _unless_sql("`end` IS NULL", f"{ts} < `end`"),
    ]
    return "coalesce(" + " AND ".join(conds) + ", false)"


def matches(plays: DataFrame, searches: DataFrame) -> DataFrame:
    """every (search, play) pair where the play matches the search.

    Text fields are AND-ed ILIKE '%v%'; years, months, dates, weekdays and
    parts are each an IN list; free terms match artist OR track.  year: and
    month: use the server zone (UTC), date:/day:/part: the search's zone --
    reference behaviour."""
    s = prepare_searches(searches)
    p = utc_plays(plays, "artist_name", "track_name", "album_name")
    p = p.select("*", *[F.lower(c).alias(f"_{c}_lc") for c in ("artist_name", "track_name", "album_name")])
    return tested(s.join(p, "user_id"))


def tested(met: DataFrame) -> DataFrame:
    """The joined (search, play) rows that fulfil the whole search."""
    return met.filter(F.expr(match_predicate())).select(
        "search_id", "user_id", "artist_name", "track_name", "album_name", "listened_at",
        "sort", "direction")


def totals(plays: DataFrame | None, searches: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Matches per search (0 when none) -- all matches, not the page.  ``matched``
    gives the matches if they are known already (``search_index``)."""
    m = matches(plays, searches) if matched is None else matched
    m = m.groupBy("search_id").agg(F.count(F.lit(1)).alias("total"))
    return (searches.select("search_id").join(m, "search_id", "left")
                    .select("search_id", F.coalesce("total", F.lit(0)).cast("long").alias("total")))


def clamp_page(limit: int, offset: int) -> tuple[int, int]:
    """Q2, for a caller that offers a pager: limit within 1..``MAX_PAGE``, offset >= 0."""
    return max(1, min(int(limit), MAX_PAGE)), max(0, int(offset))


def page(plays: DataFrame | None, searches: DataFrame, limit: int = 50, offset: int = 0,
         matched: DataFrame | None = None) -> DataFrame:
    """Q1: one page per search, ordered by the search's whitelisted column and
    direction (ASC puts NULLs last, DESC first, like Postgres), then
    listened_at desc, track, artist.  Any positive limit and offset hold."""
    limit, offset = max(1, int(limit)), max(0, int(offset))
    m = matches(plays, searches) if matched is None else matched
    by_time = F.col("sort") == "listened_at"
    sv = (F.when(F.col("sort") == "artist_name", F.col("artist_name"))
           .when(F.col("sort") == "track_name", F.col("track_name"))
           .when(F.col("sort") == "album_name", F.col("album_name")))
    tv = F.when(by_time, F.col("listened_at"))
    asc = F.col("direction") == "asc"
    nulls = F.when(by_time, F.lit(False)).when(asc, sv.isNull()).otherwise(sv.isNotNull())
    order = [nulls.asc(),
             F.when(asc, sv).asc(), F.when(~asc, sv).desc(),
             F.when(asc, tv).asc(), F.when(~asc, tv).desc(),
             F.col("listened_at").desc(), F.col("track_name").asc(), F.col("artist_name").asc()]
    ranked = top_k(m, offset + limit, ["search_id"], order, rank_col="pos")
    return (ranked.filter(F.col("pos") > offset)
                  .select("search_id", "pos", "artist_name", "track_name", "album_name", "listened_at"))
