"""Bindings of the play-history schemas to the driver's parquet test tables.

Each binding is an ordinary DataFrame plan over ``spark.read.parquet``, so it
scales with the tables: column pruning and filters reach the scan.  The SQL
text of the same bindings (run by DuckDB for the oracle) is in
``cadence.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.plans.session import local_table

# Saved-search templates run for every user: (query, tz, sort, direction,
# start, end); "{u}" is replaced by the user's id.
SEARCH_TEMPLATES = [
    ('artist:"act {u}" part:evening', "America/New_York", "listened_at", "desc", None, None),
    ("year:2024 month:jan view", "UTC", "artist_name", "asc", "2024-01-08T09:00:00+09:00", "2024-01-14T19:00:00-05:00"),
    ("date:2024-01-15 day:monday", "America/New_York", "album_name", "desc", None, None),
    ('ALBUM:"album 1" day:sat', "Mars/Phobos", "track_name", "asc", None, None),
    ("%", "UTC", "bogus", "sideways", None, None),
    ("month:13 year:abc click", "UTC", "listened_at", "asc", None, None),
    ("artist:Rock'n'Roll it's", "UTC", "listened_at", "desc", None, None),
    ("date:2024-02-31", "UTC", "listened_at", "desc", None, None),
    ("", "Asia/Tokyo", "album_name", "asc", None, None),
    ("act_1", "UTC", "artist_name", "desc", None, None),
    ('track:"" vie', "America/New_York", "listened_at", "desc", None, None),
    ("part:night day:tue date:20240116", "Asia/Tokyo", "listened_at", "asc", None, None),
    ('YEAR:2024 month:1 artist:"ACT"', "America/New_York", "album_name", "desc", None, None),
    ("click", "UTC", "listened_at", "desc", "some day", None),
]

# Searches of every customer over ``plays_long``; "{n}" is a brand number that
# depends on the customer.
LONG_SEARCHES = [
    ('artist:"brand#{n}" year:1996', "UTC"),
    ("track:ring month:3", "UTC"),
    ("date:1996-03-15", "America/New_York"),
    ("plate old year:1995 year:1997", "UTC"),
    ('album:promo artist:"#7" day:sunday', "America/New_York"),
    ("no-such-name year:1996", "UTC"),
]

# The five stand-in top tracks per tagged act, best first.
TOP_TRACK_SLOTS = [("view", 1), ("b-side", 2), ("click", 3), ("encore", 4), ("purchase", 5)]


class TestTables:
    """Lazily built bindings (FIXTURES B) over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # B.1 -----------------------------------------------------------------
    @cached_property
    def plays(self) -> DataFrame:
        e = self.table("events")
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        act = F.concat(F.lit("Act "), k.cast("string"))
        return e.select(
            F.col("event_id").alias("play_id"),
            (F.col("user_id") % 15).alias("user_id"),
            F.when(F.col("event_id") % 7 == 0, F.upper(act)).otherwise(act).alias("artist_name"),
            F.col("event_type").alias("track_name"),
            F.when(F.col("event_type") == "signup", F.lit(None).cast("string"))
             .when(F.col("event_type") == "error", F.lit(""))
             .otherwise(F.concat(F.lit("Album "), (k % 3).cast("string"))).alias("album_name"),
            F.col("ts").alias("listened_at"),
        )

    # B.2 -----------------------------------------------------------------
    @cached_property
    def plays_long(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        p = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
        return j.select(
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("l_linenumber") == 3, F.lower("p_brand")).otherwise(F.col("p_brand"))
             .alias("artist_name"),
            F.col("p_name").alias("track_name"),
            F.col("p_type").alias("album_name"),
            (F.col("o_orderdate")
             + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("listened_at"),
        )

    # B.3 -----------------------------------------------------------------
    @cached_property
    def artist_tags(self) -> DataFrame:
        p = self.table("part").select(
            F.concat(F.lit("Act "), (F.col("p_partkey") % 120).cast("string")).alias("artist_name"),
            F.when(F.col("p_size") % 3 == 0, F.upper("p_name"))
             .when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" ")))
             .otherwise(F.col("p_name")).alias("tag"),
        )
        tagged = p.groupBy("artist_name", "tag").agg(
            F.least(F.lit(100), 10 * F.count(F.lit(1))).cast("int").alias("weight"))
        silent = self.table("nation").select(
            F.concat(F.lit("Silent "), F.col("n_nationkey").cast("string")).alias("artist_name"),
            F.lit("").alias("tag"), F.lit(0).cast("int").alias("weight"))
        return tagged.unionByName(silent)

    # B.4 -----------------------------------------------------------------
    @cached_property
    def tag_blocklist(self) -> DataFrame:
        return local_table(self.spark, [("old rod",), ("small gear",)], "tag string")

    @cached_property
    def tag_aliases(self) -> DataFrame:
        return local_table(self.spark, [("hot ring", "warm ring"), ("cold ring", "warm ring")],
                           "alias string, canonical string")

    @cached_property
    def tag_exclusions(self) -> DataFrame:
        return local_table(self.spark, [("red plate", "blue ring"), ("hot bolt", "warm ring")],
                           "context_tag string, excluded_tag string")

    @property
    def curation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.tag_blocklist, self.tag_aliases, self.tag_exclusions

    # B.5 -----------------------------------------------------------------
    @cached_property
    def track_durations(self) -> DataFrame:
        k = F.expr("CAST(substr(artist_name, 5) AS INT)")
        p = self.plays.select("artist_name", "track_name", k.alias("k"))
        return (p.filter(F.col("k") % 7 != 0)
                 .select("artist_name", "track_name",
                         F.when(F.col("k") % 5 == 0, F.lit(0))
                          .otherwise(180000 + 1000 * F.col("k")).cast("int").alias("duration_ms"))
                 .distinct())

    @cached_property
    def artist_top_tracks(self) -> DataFrame:
        a = (self.artist_tags.filter(F.col("tag") != "")
             .select("artist_name", F.expr("CAST(substr(artist_name, 5) AS INT)").alias("k"))
             .distinct())
        slots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("r")) for t, r in TOP_TRACK_SLOTS])
        x = a.select("artist_name", "k", F.explode(slots).alias("s"))
        sentinel = F.col("k") % 11 == 0
        return x.select(
            "artist_name",
            F.when(sentinel, F.lit("")).otherwise(F.col("s.t")).alias("track_name"),
            F.when(sentinel, F.lit(0)).otherwise(F.col("s.r")).cast("int").alias("rank"),
        ).distinct()

    @cached_property
    def artist_feedback(self) -> DataFrame:
        """Per user: one block of an act that nobody played, one of an act that users
        did play (in other casing), and a seed; every third user's seed is looked
        up already."""
        users = self.plays.select("user_id").distinct()

        def opinion(prefix: str, number, verdict: str):
            return F.struct(F.concat(F.lit(prefix), number.cast("string")).alias("artist_name"),
                            F.lit(verdict).alias("verdict"))

        u = F.col("user_id")
        rows = F.array(opinion("ACT ", 100 + u, "block"), opinion("aCt ", 20 + u, "block"), opinion("Act ", u, "seed"))
        done = (F.col("verdict") == "seed") & (u % 3 == 0)
        return users.select("user_id", F.inline(rows)).withColumn(
            "expanded_at", F.when(done, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")))

    # B.6 and extra bindings ------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        """Customers as users; the sync mark is their latest order date, NULL
        (never synced) for customers without orders."""
        c = self.table("customer").select(F.col("c_custkey").alias("user_id"))
        o = (self.table("orders").groupBy(F.col("o_custkey").alias("user_id"))
             .agg(F.max("o_orderdate").alias("last_synced_at")))
        return c.join(o, "user_id", "left")

    @cached_property
    def feedback_events(self) -> DataFrame:
        """A feedback event log from ``events``: click = seed, error = block,
        view = clear; other event types are not feedback."""
        e = self.table("events")
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        act = F.concat(F.lit("Act "), (k % 20).cast("string"))
        action = (F.when(F.col("event_type") == "click", "seed")
                   .when(F.col("event_type") == "error", "block")
                   .when(F.col("event_type") == "view", "clear"))
        return (e.select((F.col("user_id") % 15).alias("user_id"),
                         F.when(F.col("event_id") % 7 == 0, F.upper(act)).otherwise(act).alias("artist_name"),
                         action.alias("action"), F.col("ts").alias("event_ts"),
                         F.col("event_id").alias("seq"))
                 .filter(F.col("action").isNotNull()))

    @cached_property
    def suggested_names(self) -> DataFrame:
        """A batch of similar-artist names in lower case, some known, some not."""
        return (self.table("part")
                .select(F.concat(F.lit("act "), (F.col("p_partkey") % 150).cast("string")).alias("name"))
                .distinct())

    @cached_property
    def searches(self) -> DataFrame:
        """Every template above for every user of ``plays`` (search_id 'u-i'),
        generated per user row by one ``inline`` expression."""
        from cadence.functions.search import sql_str

        def lit(v):
            return "CAST(NULL AS STRING)" if v is None else sql_str(v)

        rows = []
        for i, (q, tz, sort, direction, start, end) in enumerate(SEARCH_TEMPLATES):
            head, _, tail = q.partition("{u}")
            query = (f"concat({sql_str(head)}, CAST(user_id AS STRING), {sql_str(tail)})"
                     if "{u}" in q else sql_str(q))
            rows.append(f"named_struct('i', {i}, 'query', {query}, 'tz', {lit(tz)}, 'sort', {lit(sort)}, "
                        f"'direction', {lit(direction)}, 'start', {lit(start)}, 'end', {lit(end)})")
        users = self.plays.select("user_id").distinct()
        s = users.select("user_id", F.expr(f"inline(array({', '.join(rows)}))"))
        return s.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("i").cast("string"))
                        .alias("search_id"), "user_id", "query", "tz", "sort", "direction", "start", "end")

    @cached_property
    def fetched_spans(self) -> DataFrame:
        """Spans of fetched history per customer: from each ship date, nine days a line
        number; returned lines ('R') were cut off and fetched nothing."""
        li = self.table("lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_shipdate", "l_linenumber")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("o_custkey").cast("long").alias("user_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("since"),
            (F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_linenumber") * 9).cast("int"))).cast("timestamp_ntz").alias("until"))

    @cached_property
    def searches_long(self) -> DataFrame:
        """``LONG_SEARCHES`` for every customer with plays (search_id 'u-i')."""
        number = (F.col("user_id") % 25 + 1).cast("string")
        rows = [F.struct(F.lit(i).alias("i"), F.replace(F.lit(q), F.lit("{n}"), number).alias("query"), F.lit(tz).alias("tz"))
                for i, (q, tz) in enumerate(LONG_SEARCHES)]
        users = self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        users = users.select(F.col("o_custkey").alias("user_id")).distinct()
        return (users.select("user_id", F.inline(F.array(*rows)))
                .select(F.concat_ws("-", "user_id", "i").alias("search_id"), "user_id", "query", "tz"))

    @cached_property
    def sync_runs(self) -> DataFrame:
        """Sync runs per customer: one per shipped line, started at the ship
        date; runs of returned lines ('R') count as failed."""
        li = self.table("lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .select(F.col("o_custkey").alias("user_id"), F.col("l_shipdate").alias("started_at"),
                          (F.col("l_returnflag") != "R").alias("completed")))
