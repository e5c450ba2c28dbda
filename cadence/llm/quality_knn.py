"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text becomes TF-IDF weights of hashed terms: byte n-grams with case and
punctuation kept, and pairs of word shapes (case, letters, marks, same as the
word before).  A truncated singular value decomposition of the labelled sample's
weights gives the latent space.  The labelled vectors, a bounded sample of at
most ``per_label`` documents of each label, go to every task; each batch of
documents is compared with all of them by one exact matrix product, and the
``neighbours`` with the largest cosine vote with their label, weighted by
similarity.

Applying is one pass over all texts in Arrow batches, without a shuffle.  What is
sent to the tasks is (2 x per_label) x ``RANK`` + ``DIMS`` x ``RANK`` floats.

Defined results: null or empty text, or one unlike all labelled texts, gets the
share of label 1 among all labels; without labelled rows every score is 0.5.  Of
neighbours with the same cosine at the last place one is taken, the same each
run.  Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import (bounded_sample, chunks, crc_remainder, dense_rows, ngram_counts, sparse_bytes,
                                unit_rows, window_hashes, with_text_columns, word_hashes, word_spans)

GRAM_DIMS, SHAPE_DIMS = 4096, 1024
DIMS = GRAM_DIMS + SHAPE_DIMS
RANK = 64


def _byte_class() -> np.ndarray:
    return np.minimum(np.arange(256), 254).astype(np.uint8)


def _kinds() -> np.ndarray:
    """Byte kinds for word shapes: 1 lower case, 2 upper case, 4 digit, 8 sentence
    mark, 16 other mark, 32 beyond ASCII."""
    k = np.full(256, 16, dtype=np.uint8)
    k[97:123], k[65:91], k[48:58], k[128:] = 1, 2, 4, 32
    k[[ord(c) for c in ".,;:!?"]] = 8
    return k


_CLASS, _KIND = _byte_class(), _kinds()


def shape_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed pairs of word shapes.  The shape of a word: the kinds of
    bytes in it, its length class, whether it equals the word before."""
    out = np.zeros((len(texts), SHAPE_DIMS), dtype=np.float32)
    for first, part in chunks(texts):
        a, starts, ends, before = word_spans(part)
        if len(starts) < 2:
            continue
        h, _ = word_hashes(part, lower=False)
        kinds = _KIND[a]
        bounds = np.stack((starts, ends), axis=1).ravel()
        shape = np.bitwise_or.reduceat(kinds, bounds)[0::2].astype(np.uint64)
        shape |= (np.minimum(ends - starts, 15) // 4).astype(np.uint64) << np.uint64(8)
        shape[1:] |= (h[1:] == h[:-1]).astype(np.uint64) << np.uint64(12)
        pair = (window_hashes(shape, 2, stream=41) % np.uint64(SHAPE_DIMS)).astype(np.int64)
        doc = np.repeat(np.arange(len(part)), np.diff(before))
        same = doc[1:] == doc[:-1]
        total = np.bincount(doc[:-1][same] * SHAPE_DIMS + pair[same], minlength=len(part) * SHAPE_DIMS)
        out[first:first + len(part)] = total.reshape(len(part), SHAPE_DIMS)
    return out


def term_counts(texts: list[str]) -> np.ndarray:
    return np.concatenate((ngram_counts(texts, _CLASS, (3,), GRAM_DIMS), shape_counts(texts)), axis=1)


@dataclass(frozen=True)
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray  # DIMS x RANK
    vectors: np.ndarray  # unit rows of the labelled documents
    labels: np.ndarray
    base_rate: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(weighted(counts, self.idf) @ self.axes)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with the shape terms' block as long as the n-grams' block."""
    x = np.log1p(counts) * idf
    return np.concatenate((unit_rows(x[:, :GRAM_DIMS]), unit_rows(x[:, GRAM_DIMS:])), axis=1)


def fit_counts(counts: np.ndarray, labels: np.ndarray, rank: int = RANK, base_rate: float | None = None,
               steps: int = 4) -> NeighbourModel:
    """Latent space by subspace iteration on the sample (deterministic start)."""
    n = len(labels)
    idf = (np.log((1.0 + n) / (1.0 + (counts > 0).sum(axis=0))) + 1.0).astype(np.float32) if n else np.ones(
        DIMS, np.float32)
    if not n:
        return NeighbourModel(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    x = weighted(counts, idf)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((n, min(rank, n))).astype(np.float32))[0]
    for _ in range(steps):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    rate = float(labels.mean()) if base_rate is None else base_rate
    return NeighbourModel(idf, q.astype(np.float32), unit_rows(x @ q).astype(np.float32), labels.astype(np.int64), rate)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        per_label: int = 1500, rank: int = RANK) -> NeighbourModel:
    """Fit on at most ``per_label`` labelled documents of each label (0, 1)."""
    rows = labels.select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_label")).filter(
        "_key IS NOT NULL AND _label IS NOT NULL")
    shares = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # two rows
    chosen = bounded_sample(rows, "_key", per_label, "_label")
    got = documents.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(
        F.broadcast(chosen), "_key")  # at most 2 x per_label rows are broadcast
    packed = with_text_columns(got.select("_key", "_label", "_t"), "_t", lambda ts: [sparse_bytes(term_counts(ts))],
                               "terms binary", keep=["_key", "_label"]).collect()
    packed.sort(key=lambda r: (str(r["_key"]), r["_label"], bytes(r["terms"])))
    rate = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    return fit_counts(dense_rows([bytes(r["terms"]) for r in packed], DIMS),
                      np.array([r["_label"] for r in packed], dtype=np.int64), rank, rate)


def score(model: NeighbourModel, texts: list[str], neighbours: int = 15, power: float = 4.0) -> np.ndarray:
    """Share of label 1 in the similarity-weighted votes of the nearest labelled
    vectors (cosine to the given power; negative cosines have no weight)."""
    n, m = len(texts), len(model.labels)
    if not m or not n:
        return np.full(n, 0.5)
    cosine = model.latent(term_counts(texts)) @ model.vectors.T
    k = min(neighbours, m)
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(cosine, top, axis=1), 0.0, 1.0).astype(float) ** power
    votes = (weight * model.labels[top]).sum(axis=1)
    total = weight.sum(axis=1)
    return np.where(total > 0, votes / np.where(total > 0, total, 1.0), model.base_rate)


def classify(documents: DataFrame, model: NeighbourModel, text: str = "text", keep: list[str] | None = None,
             neighbours: int = 15) -> DataFrame:
    """``documents`` with score and predicted (1 if score >= 0.5)."""
    def run(texts: list[str]):
        s = score(model, texts, neighbours)
        return [s, (s >= 0.5).astype(np.int32)]

    return with_text_columns(documents, text, run, "score double, predicted int", keep)


def held_out(doc_id: Column) -> Column:
    """Rows that the registered query never learns from."""
    return F.coalesce(crc_remainder(doc_id, 3) == 1, F.lit(False))
