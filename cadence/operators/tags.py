"""Tag curation (C1-C3): the clean view every genre operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans.session import bounded_broadcast

# curation rule tables are hand-maintained lists; far below this bound
_RULE_ROWS = 100_000


def clean_tags(artist_tags: DataFrame, blocklist: DataFrame, aliases: DataFrame,
               exclusions: DataFrame) -> DataFrame:
    """One row per (artist, canonical tag) with the strongest weight.

    Drop the '' sentinel; lower(trim()); apply aliases (J3); drop blocklisted
    tags after aliasing (J4); drop the tags an artist's context tag suppresses
    (J5, J6), built once as a set and anti-joined.  A tag of spaces becomes ''
    after trimming and is dropped too (deviation: the reference would keep an
    empty tag).  Rule tables are broadcast behind a size check.
    """
    raw = artist_tags.select("artist_name", "tag", "weight").filter(F.col("tag") != "")
    al = bounded_broadcast(aliases.select("alias", "canonical"), _RULE_ROWS)
    bl = bounded_broadcast(blocklist.select("tag"), _RULE_ROWS)
    ex = bounded_broadcast(exclusions.select("context_tag", "excluded_tag"), _RULE_ROWS)
    low = raw.withColumn("_low", F.lower(F.trim("tag")))
    mapped = (low.join(al, low["_low"] == al["alias"], "left")
                 .select("artist_name", F.coalesce("canonical", "_low").alias("tag"), "weight")
                 .filter(F.col("tag") != ""))
    allowed = mapped.join(bl, "tag", "left_anti")
    suppressed = (allowed.join(ex, allowed["tag"] == ex["context_tag"])
                         .select("artist_name", F.col("excluded_tag").alias("tag"))
                         .distinct())
    return (allowed.join(suppressed, ["artist_name", "tag"], "left_anti")
                   .groupBy("artist_name", "tag").agg(F.max("weight").alias("weight")))


def primary_tag(clean: DataFrame) -> DataFrame:
    """Each artist's strongest clean tag, ties to the alphabetically first.

    A min over struct(-weight, tag) is a plain hash aggregate with map-side
    partial results, so no per-artist sort is needed."""
    best = F.min(F.struct((-F.col("weight")).alias("nw"), F.col("tag").alias("tag")))
    return clean.groupBy("artist_name").agg(best.alias("_b")).select("artist_name", "_b.tag")


def tag_corpus(clean: DataFrame) -> DataFrame:
    """One spelling per case-folded artist (its modal spelling among the
    clean rows, ties to the lowest) with the max weight per tag."""
    k = clean.withColumn("akey", F.lower("artist_name"))
    per = k.groupBy("akey", "artist_name").agg(F.count(F.lit(1)).alias("n"))
    canon = (per.groupBy("akey")
                .agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("artist_name").alias("v"))).alias("_m"))
                .select("akey", F.col("_m.v").alias("display")))
    per_tag = k.groupBy("akey", "tag").agg(F.max("weight").alias("weight"))
    return (per_tag.join(canon, "akey")
                   .select(F.col("display").alias("artist_name"), "tag", "weight"))
