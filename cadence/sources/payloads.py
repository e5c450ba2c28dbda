"""Music-API JSON payloads -> typed rows (S2-S6), for batch and streaming.

Each parser takes a DataFrame with one JSON document per row in column
``value`` (what ``spark.read.text`` / ``readStream.text`` give) and returns
rows.  The API returns a bare object instead of a one-element list, so list
fields are read as raw JSON strings first and parsed again with an array
schema: Spark's ``from_json`` turns a lone root object into a one-element
array, which covers both shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

RECENT_ENVELOPE = ("recenttracks struct<track: string, "
                   "`@attr`: struct<user: string, page: string, totalPages: string>>")
RECENT_TRACK = ("array<struct<name: string, artist: struct<`#text`: string>, "
                "album: struct<`#text`: string>, date: struct<uts: string, `#text`: string>>>")
TAGS_ENVELOPE = "toptags struct<tag: string, `@attr`: struct<artist: string>>"
TAG_ITEM = "array<struct<name: string, count: string>>"
SIMILAR_ENVELOPE = "similarartists struct<artist: string, `@attr`: struct<artist: string>>"
SIMILAR_ITEM = "array<struct<name: string, `match`: string>>"
TOPTRACKS_ENVELOPE = "toptracks struct<track: string, `@attr`: struct<artist: string>>"
TOPTRACK_ITEM = "array<struct<name: string>>"
TRACKINFO = "track struct<name: string, duration: string, artist: struct<name: string>>, error int"


def _list(raw: Column, schema: str) -> Column:
    """A JSON list field that may also be a bare object (or absent)."""
    return F.coalesce(F.from_json(raw, schema), F.array())


def _seconds_to_ntz(secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs.cast("bigint"), F.expr(_EPOCH))


def parse_recent_tracks(pages: DataFrame) -> DataFrame:
    """Recent-tracks pages -> (username, page, total_pages, artist_name,
    track_name, album_name, listened_at).  Now-playing rows (no date) are
    dropped, an empty album becomes NULL, ``uts`` becomes UTC wall clock."""
    env = pages.select(F.from_json("value", RECENT_ENVELOPE).alias("e")).select("e.recenttracks.*")
    rows = env.select(F.col("`@attr`.user").alias("username"),
                      F.col("`@attr`.page").cast("int").alias("page"),
                      F.coalesce(F.col("`@attr`.totalPages").cast("int"), F.lit(1)).alias("total_pages"),
                      F.explode(_list(F.col("track"), RECENT_TRACK)).alias("t"))
    return (rows.filter(F.col("t.date").isNotNull())
                .select("username", "page", "total_pages",
                        F.col("t.artist.`#text`").alias("artist_name"),
                        F.col("t.name").alias("track_name"),
                        F.nullif(F.col("t.album.`#text`"), F.lit("")).alias("album_name"),
                        _seconds_to_ntz(F.col("t.date.uts")).alias("listened_at")))


def recent_tracks_rejects(pages: DataFrame) -> DataFrame:
    """The pages of S2 that are no recent-tracks answer: malformed text, API errors.
    A sync run with a rejected page is not complete, so its mark must not move
    (``ingest.completed_runs``)."""
    keys = F.json_object_keys("value")
    good = F.array_contains(keys, "recenttracks") & ~F.array_contains(keys, "error")
    return pages.filter(~F.coalesce(good, F.lit(False)))


def rejects(docs: DataFrame) -> DataFrame:
    """Answers of S3-S6 that are no JSON object and must be fetched again."""
    return docs.filter(F.json_object_keys("value").isNull())


def _asked(docs: DataFrame, field: str) -> Column:
    """The artist asked for: the ``artist_name`` column next to ``value`` if there is
    one (an error answer names no artist), else the answer's."""
    said = F.col(f"e.{field}.`@attr`.artist")
    return F.coalesce(F.col("artist_name"), said) if "artist_name" in docs.columns else said


def parse_track_info(docs: DataFrame) -> DataFrame:
    """S3: track.getInfo -> (artist_name, track_name, duration_ms); a missing
    track (API error) or duration is 0.  ``docs`` carries the asked
    artist/track next to ``value``."""
    j = docs.withColumn("_j", F.from_json("value", TRACKINFO))
    dur = F.when(F.col("_j.track").isNull(), F.lit(0)) \
           .otherwise(F.coalesce(F.col("_j.track.duration").try_cast("int"), F.lit(0)))
    return j.select("artist_name", "track_name", dur.alias("duration_ms"))


def parse_artist_tags(docs: DataFrame) -> DataFrame:
    """Artist.getTopTags -> (artist_name, tag, weight); an artist without
    tags, or unknown to the API, gets the sentinel row ('', 0).  An answer that is
    no JSON, or names no artist, gives no row (see ``rejects``)."""
    env = docs.filter(F.json_object_keys("value").isNotNull()).withColumn("e", F.from_json("value", TAGS_ENVELOPE))
    env = env.select(_asked(docs, "toptags").alias("artist_name"), "e.toptags.tag").filter("artist_name IS NOT NULL")
    items = env.select("artist_name",
                       F.filter(_list(F.col("tag"), TAG_ITEM),
                                lambda t: t["name"].isNotNull() & (t["name"] != "")).alias("tags"))
    x = items.select("artist_name", F.explode_outer("tags").alias("t"))
    return x.select("artist_name", F.coalesce(F.col("t.name"), F.lit("")).alias("tag"),
                    F.coalesce(F.col("t.count").try_cast("int"), F.lit(0)).alias("weight"))


def parse_similar_artists(docs: DataFrame) -> DataFrame:
    """Artist.getSimilar -> (seed_artist, artist_name, position from 1)."""
    env = docs.select(F.from_json("value", SIMILAR_ENVELOPE).alias("e")).select("e.similarartists.*")
    items = env.select(F.col("`@attr`.artist").alias("seed_artist"),
                       F.filter(_list(F.col("artist"), SIMILAR_ITEM),
                                lambda t: t["name"].isNotNull() & (t["name"] != "")).alias("a"))
    x = items.select("seed_artist", F.posexplode("a").alias("pos", "s"))
    return x.select("seed_artist", F.col("s.name").alias("artist_name"),
                    (F.col("pos") + 1).alias("position"))


def parse_top_tracks(docs: DataFrame) -> DataFrame:
    """Artist.getTopTracks -> (artist_name, track_name, rank from 1); an
    unknown artist gets the sentinel row ('', 0).  An answer that is no JSON, or
    names no artist, gives no row (see ``rejects``)."""
    env = docs.filter(F.json_object_keys("value").isNotNull()).withColumn("e", F.from_json("value", TOPTRACKS_ENVELOPE))
    env = env.select(_asked(docs, "toptracks").alias("artist_name"), "e.toptracks.track").filter("artist_name IS NOT NULL")
    items = env.select("artist_name",
                       F.filter(_list(F.col("track"), TOPTRACK_ITEM),
                                lambda t: t["name"].isNotNull() & (t["name"] != "")).alias("t"))
    x = items.select("artist_name", F.posexplode_outer("t").alias("pos", "s"))
    return x.select("artist_name", F.coalesce(F.col("s.name"), F.lit("")).alias("track_name"),
                    F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.col("pos") + 1).cast("int").alias("rank"))
