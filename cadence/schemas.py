"""Schemas of the play-history tables and the default curation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PLAYS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("track_name", T.StringType(), False),
    T.StructField("album_name", T.StringType(), True),
    T.StructField("listened_at", T.TimestampNTZType(), False),
])
# a play's identity: artist is deliberately not part of it
PLAY_KEY = ["user_id", "track_name", "listened_at"]

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("last_synced_at", T.TimestampNTZType(), True),
])
TRACK_DURATIONS = T.StructType([
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("track_name", T.StringType(), False),
    T.StructField("duration_ms", T.IntegerType(), False),
])
DURATION_KEY = ["artist_name", "track_name"]
ARTIST_TAGS = T.StructType([
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("weight", T.IntegerType(), False),
])
TAG_KEY = ["artist_name", "tag"]
ARTIST_TOP_TRACKS = T.StructType([
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("track_name", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False),
])
TOP_TRACK_KEY = ["artist_name", "track_name"]
RECOMMENDATIONS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("computed_at", T.TimestampNTZType(), True),
])
FEEDBACK = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("expanded_at", T.TimestampNTZType(), True),
])
FEEDBACK_EVENTS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("artist_name", T.StringType(), False),
    T.StructField("action", T.StringType(), False),  # seed | block | clear
    T.StructField("event_ts", T.TimestampNTZType(), False),
])

# The default curation rules (lowercase), as seeded by the
# reference schema.  Non-taste tags dropped unconditionally:
DEFAULT_TAG_BLOCKLIST = [
    "american", "america", "usa", "us", "united states",
    "british", "uk", "united kingdom", "england", "english", "britain",
    "canadian", "canada", "australian", "australia",
    "favorite", "favourite", "favorites", "favourites", "best", "good",
    "great", "awesome", "amazing", "beautiful", "love", "loved",
    "classic", "masterpiece", "legendary", "underrated", "overrated",
    "essential", "recommended", "must hear",
    "top", "top tracks", "top albums", "seen live", "live",
    "want to see live", "owned", "my music", "collection", "playlist",
    "repeat", "repeatable", "scrobbled", "lastfm", "last.fm",
    "my top songs", "all", "art", "beats", "x factor",
    "spotify", "youtube", "tiktok", "tik tok", "headphones", "meme",
]
# Spelling variants -> canonical tag.
DEFAULT_TAG_ALIASES = [
    ("hip hop", "hip-hop"),
    ("r&b", "rnb"),
    ("female vocalist", "female vocalists"),
    ("male vocalist", "male vocalists"),
    ("kpop", "k-pop"),
    ("k pop", "k-pop"),
    ("dnb", "drum and bass"),
    ("drum n bass", "drum and bass"),
    ("trip hop", "trip-hop"),
    ("synth pop", "synthpop"),
    ("pop-punk", "pop punk"),
    ("alt rock", "alternative rock"),
]
# Fixed values: (context tag, tag it makes meaningless on the same artist).
DEFAULT_TAG_EXCLUSIONS = [
    ("bollywood", "pop"), ("bollywood", "hip-hop"),
    ("indian", "pop"), ("indian", "hip-hop"),
    ("india", "pop"), ("india", "hip-hop"),
]


def default_curation(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocklist, aliases, exclusions) DataFrames holding the default rules."""
    from cadence.plans.session import local_table
    block = local_table(spark, [(t,) for t in DEFAULT_TAG_BLOCKLIST], "tag string")
    alias = local_table(spark, DEFAULT_TAG_ALIASES, "alias string, canonical string")
    excl = local_table(spark, DEFAULT_TAG_EXCLUSIONS, "context_tag string, excluded_tag string")
    return block, alias, excl
