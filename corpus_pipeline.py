"""The training-data pipeline: five stages over ``documents``.

Each stage gets the documents that its predecessor kept, reads the side tables
(labels, benchmark) from ``sf_dir`` itself, and returns the documents it keeps
with all their columns; the last one returns packed pieces.  Models are fitted
on the stage's own input.

Defined results: null and empty texts are rejected by the quality rules; copies and
benchmark items are found by row, whatever its id: a row with a null id comes after
those with one, rows of one id with other texts are judged each by its own; rows
that repeat an id and text count as copies of each other; rows without id and words
have no copies; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import decontaminate, language_id, ngram_join, packing, quality_rules
from cadence.llm.common import table
from cadence.plans.session import bounded_broadcast, materialize


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` that fulfil ``condition`` on the columns that ``judge``
    adds; its names cannot clash with those of ``docs``."""
    own = [f"_doc_{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*own), own[docs.columns.index("text")])
    return judged.filter(condition).select(*own).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees accept."""
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d, text: quality_rules.judge(d, trees, text), "kept")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return _kept(docs, lambda d, text: language_id.identify(d, model, text), "NOT rejected")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, which names a row by id and text (64-bit hash), ordered by
    id, null ids last; only rows that repeat both share one."""
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                                            F.xxhash64("text").alias("text")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id."""
    keyed = _keyed(docs)
    groups = ngram_join.link_components(keyed, key="_key").filter("_key = component_id")
    stays = materialize(groups.groupBy("_key").agg(F.count("*").alias("_rows"), F.max("n_shingles").alias("_shingles")), "stays")
    # a row for nearly every document: a merge join at every size
    kept = keyed.join(stays.hint("merge"), "_key")
    alone = F.expr("_rows = 1 OR doc_id IS NULL AND _shingles = 0")
    once = kept.filter(alone).select(*docs.columns)
    repeated = kept.filter(~alone).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    hits = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), key="_key")
    hits = materialize(hits.select("_key").distinct(), "hits")
    # few documents hold an item; beyond the bound the join shuffles both sides
    return keyed.join(bounded_broadcast(hits, 1_000_000), "_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the trees, centroids and packing; tests compare the stages
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
