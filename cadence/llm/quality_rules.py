"""Quality rules: document statistics judged by gradient-boosted trees.

Statistics are computed from the whole text.  The trees are fitted here on the
labelled documents' statistics (logistic loss, histogram splits, monotonic
constraints on chosen features), then flattened into node arrays, one row a
tree, so that a batch is scored by stepping all rows down all trees at once.

Fitting uses a bounded sample of labelled rows: the ``labelled`` ones with the
smallest hashed id; their statistics (not their texts) go to the driver.  Scoring
is one pass over all texts in Arrow batches, without a shuffle.

Defined results: null text has no words, n_words 0 and base_failed true; without
labelled rows, or with labels of one kind, the trees accept everything and only
the base rules reject.  Repeated rows are judged alike; label rows without a
label are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import WORD, bounded_sample, with_text_columns

SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
REPEAT = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the sign their effect on quality must have (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "same_as_previous": -1, "distinct_share": 0, "upper_share": -1, "punctuation_share": 0, "pipe_share": -1,
    "bang_share": -1, "digit_share": 0, "end_mark_share": 0, "words_per_line": 0,
}


def repeated_words(words: list[str], width: int = REPEAT) -> int:
    """Words inside ``width``-word windows that occur at least twice, the first
    occurrence included.  Windows are told apart exactly: word numbers are paired,
    pairs of windows renumbered, until a number stands for a whole window."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    window = ids
    for k in range(1, width):
        _, window, counts = np.unique(window[:-1] * len(number) + ids[k:], return_inverse=True, return_counts=True)
        if len(counts) == len(window):
            return 0  # no window of this length repeats, so no longer one does
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[window] > 1)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(the BASE statistics, the FEATURES) of one text."""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    w, c = max(n, 1), max(chars, 1)
    upper = sum(1 for x in words if x.isupper() and len(x) > 1)
    marks = sum(map(text.count, ".,;:!?"))
    features = [
        np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeated / w,
        sum(map(str.__eq__, words[1:], words)) / w, len(set(words)) / w, upper / w, marks / w, text.count("|") / w,
        text.count("!") / w, sum(map(text.count, "0123456789")) / c, (text.count(". ") + text.count(".\n")) / w,
        n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup, repeated], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


# --- gradient-boosted trees ---------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, one row a tree.  Node i has children 2i+1 and
    2i+2; a row goes right where its feature is above the threshold."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth), added to the log-odds
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        n, inner = len(x), self.feature.shape[1]
        if not n or not len(self.feature):
            return np.full(n, 1.0 / (1.0 + np.exp(-self.start)))
        tree, node = np.arange(len(self.feature)), np.zeros((n, len(self.feature)), dtype=np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(int(inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        odds = self.start + self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-odds))


def _split(hist_g, hist_h, low, high, signs, ridge, least):
    """Best (gain, feature, bin, left value, right value) of a node, or None.  Leaf
    values stay within [low, high], and rise or fall with a constrained feature."""
    gl, hl = np.cumsum(hist_g, axis=1)[:, :-1], np.cumsum(hist_h, axis=1)[:, :-1]
    g, h = hist_g.sum(axis=1, keepdims=True), hist_h.sum(axis=1, keepdims=True)
    gr, hr = g - gl, h - hl
    left = np.clip(-gl / (hl + ridge), low, high)
    right = np.clip(-gr / (hr + ridge), low, high)
    whole = np.clip(-g / (h + ridge), low, high)

    def fall(v, gg, hh):  # by how much a leaf value lowers the loss
        return -(gg * v + 0.5 * (hh + ridge) * v * v)

    gain = fall(left, gl, hl) + fall(right, gr, hr) - fall(whole, g, h)
    gain[(hl < least) | (hr < least)] = -np.inf
    gain[(signs[:, None] * (right - left)) < 0] = -np.inf
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, b] > 1e-9:
        return None
    return gain[f, b], int(f), int(b), float(left[f, b]), float(right[f, b])


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3,
              rate: float = 0.3, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    inner = 2 ** depth - 1
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 40.0)
    if not len(y) or y.min() == y.max():
        return none if not len(y) or y.min() else Trees(none.feature, none.threshold, none.leaf, -40.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    odds = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-odds))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        value = np.zeros(2 * inner + 1)
        bound = [(-8.0, 8.0)] * (2 * inner + 1)
        node = np.zeros(len(y), np.int64)
        value[0] = 0.0
        for i in range(inner):
            own = np.flatnonzero(node == i)
            found = None
            if len(own):
                key = binned[:, own] + (np.arange(len(x.T)) * bins)[:, None]
                weights = lambda v: np.bincount(key.ravel(), np.broadcast_to(v[own], key.shape).ravel(),
                                                minlength=bins * len(x.T)).reshape(-1, bins)
                found = _split(weights(g), weights(h), *bound[i], signs, ridge, least)
            left, right = 2 * i + 1, 2 * i + 2
            if found is None:  # everything goes left, with the node's own value
                value[left] = value[right] = value[i]
                bound[left] = bound[right] = bound[i]
                node[own] = left
                continue
            _, f, b, lv, rv = found
            if b >= len(edges[f]):
                value[left] = value[right] = value[i]
                bound[left] = bound[right] = bound[i]
                node[own] = left
                continue
            feature[i], threshold[i] = f, edges[f][b]
            value[left], value[right] = lv, rv
            low, high = bound[i]
            middle = (lv + rv) / 2
            bound[left] = (low, middle) if signs[f] > 0 else (middle, high) if signs[f] < 0 else (low, high)
            bound[right] = (middle, high) if signs[f] > 0 else (low, middle) if signs[f] < 0 else (low, high)
            node[own] = np.where(x[own, f] > threshold[i], right, left)
        leaf = rate * value[inner:]
        odds = odds + leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        label: str = "quality", labelled: int = 8000) -> Trees:
    """Trees fitted on at most ``labelled`` labelled documents."""
    chosen = bounded_sample(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
                            .filter("_key IS NOT NULL AND _label IS NOT NULL"), "_key", labelled)
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(
        F.broadcast(chosen), "_key").select("_key", "_label", "_t")  # at most ``labelled`` rows are broadcast
    got = with_text_columns(rows, "_t", lambda ts: [[statistics(t)[1] for t in ts]], "x array<double>",
                            keep=["_key", "_label"]).collect()
    got.sort(key=lambda r: (str(r["_key"]), r["_label"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    return fit_trees(x, np.array([float(r["_label"] > 0) for r in got]), np.array(list(FEATURES.values())))


def judge(documents: DataFrame, model: Trees, text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """``documents`` with the BASE statistics, base_failed, quality_score (the
    trees' probability) and kept."""
    def run(texts: list[str]):
        found = [statistics(t) for t in texts]
        base = np.array([b for b, _ in found], dtype=np.int64).reshape(len(texts), len(BASE))
        quality = model.probability(np.array([f for _, f in found]).reshape(len(texts), len(FEATURES)))
        failed = np.array([base_failed(b[0], b[4]) for b in base.tolist()], dtype=bool)
        return [*base.T, failed, quality, ~failed & (quality >= threshold)]

    fields = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, quality_score double, kept boolean"
    return with_text_columns(documents, text, run, fields, keep)
