"""Language identification by nearest centroid.

Texts become vectors of hashed byte n-grams (letters only, lower case), weighted
by TF-IDF and scaled to length 1.  Each language has several centroids, found by
spherical k-means over its training texts; a text gets the language of the
centroid with the largest cosine.  A text farther from all centroids of its
language than nearly all training texts were is rejected.

The model is fitted on the driver from a bounded sample: at most
``per_language`` labelled rows of each language, those with the smallest hashed
id.  Applying it is one pass over all texts in Arrow batches, without a shuffle;
the model in the closure holds some centroids of ``DIMS`` floats a language.

Defined results: null text or a text without a letter: ``und``, score 0,
rejected; without any training row every text is ``und``.  Ties between
centroids go to the language that sorts first.  Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import (bounded_sample, crc_remainder, dense_rows, ngram_counts, sparse_bytes,
                                unit_rows, with_text_columns)
from cadence.plans.session import bounded_broadcast

DIMS = 4096
SIZES = (2, 3)
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Byte classes: letters a-z (any case), the bytes of non-ASCII characters
    (upper-case Latin-1 as lower-case), all else 0."""
    c = np.zeros(256, dtype=np.uint8)
    c[97:123] = np.arange(1, 27)
    c[65:91] = c[97:123]
    c[128:255] = np.arange(27, 27 + 127)
    c[128:159] = c[160:191]
    return c


_CLASS = _letters()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    least: np.ndarray  # of each centroid's language: smallest accepted cosine


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * idf)


def _k_means(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means: the first centre is the row nearest the mean, each next
    one the row farthest from the centres so far; empty clusters keep theirs."""
    centres = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(centres) < min(k, len(x)):
        centres.append(int(np.argmin((x @ x[centres].T).max(axis=1))))
    c = x[centres].copy()
    for _ in range(steps):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c = unit_rows(c)
    return c


def fit_counts(languages: list[str], counts: np.ndarray, clusters: int = 4, slack: float = 0.5) -> LanguageModel:
    """The model of labelled n-gram counts, a dense row a text."""
    return fit_sparse(languages, sparse_bytes(counts), clusters, slack)


def fit_sparse(languages: list[str], packed: list[bytes], clusters: int = 4, slack: float = 0.5) -> LanguageModel:
    """The model of labelled n-gram counts (``sparse_bytes``).  The smallest accepted
    cosine of a language is ``slack`` times the 0.1 % quantile of its training texts, since
    unseen short texts lie farther out than those that shaped the centroids.  Only one
    language's rows are dense at a time."""
    if not len(languages):
        return LanguageModel((), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))
    held = np.zeros(DIMS, dtype=np.int64)
    for b in packed:
        held[np.frombuffer(b, "<u2", len(b) // 6)] += 1  # a place stands once in a row
    idf = np.log((1.0 + len(packed)) / (1.0 + held)).astype(np.float32) + np.float32(1.0)
    names, rows, least = [], [], []
    for lang in sorted(set(languages)):
        own = vectors(dense_rows([b for b, of in zip(packed, languages) if of == lang], DIMS), idf)
        c = _k_means(own, clusters)
        floor = slack * float(np.quantile((own @ c.T).max(axis=1), 0.001))
        names += [lang] * len(c)
        rows.append(c)
        least += [floor] * len(c)
    return LanguageModel(tuple(names), np.concatenate(rows).astype(np.float32), idf, np.array(least))


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_language: int = 1000, clusters: int = 4) -> LanguageModel:
    """Fit on at most ``per_language`` texts of every non-null ``lang``; of an id that
    repeats, one text."""
    chosen = bounded_sample(documents.filter(F.col(lang).isNotNull() & F.col(key).isNotNull())
                            .select(F.col(key).alias("_key"), F.col(lang).alias("_lang")), "_key", per_language, "_lang")
    rows = documents.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_t")).join(
        bounded_broadcast(chosen, 200_000), ["_key", "_lang"], "left_semi").filter("_t IS NOT NULL")
    found = with_text_columns(rows, "_t", lambda ts: [sparse_bytes(ngram_counts(ts, _CLASS, SIZES, DIMS))],
                              "grams binary", keep=["_key", "_lang"])
    packed = found.groupBy("_key", "_lang").agg(F.min("grams").alias("grams")).collect()
    packed.sort(key=lambda r: (str(r["_key"]), r["_lang"], bytes(r["grams"])))
    return fit_sparse([r["_lang"] for r in packed], [bytes(r["grams"]) for r in packed], clusters)


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine clipped to 0..1, rejected) of each text."""
    lang = [UNKNOWN] * len(texts)
    score, rejected = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    have = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.languages else []
    if have:
        cosine = vectors(ngram_counts([texts[i] for i in have], _CLASS, SIZES, DIMS), model.idf) @ model.centroids.T
        best = np.argmax(cosine, axis=1)
        top = cosine[np.arange(len(have)), best].astype(float)
        score[have] = np.clip(top, 0.0, 1.0)
        rejected[have] = top < model.least[best]
        for i, b in zip(have, best):
            lang[i] = model.languages[b]
    return lang, score, rejected


def identify(documents: DataFrame, model: LanguageModel, text: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``documents`` with lang_pred, score and rejected."""
    return with_text_columns(documents, text, lambda ts: predict(model, ts),
                             "lang_pred string, score double, rejected boolean", keep)


def held_out(doc_id: Column) -> Column:
    """Rows that the registered query never learns from."""
    return F.coalesce(crc_remainder(doc_id, 4) == 2, F.lit(False))
