"""URL filter: host/path rules, then logistic regression on character n-grams.

``judge`` cuts host and path out of every URL with column expressions, applies
the rules (longest fitting rule wins) and lets the model decide the rest.  The
model is a logistic regression over hashed byte n-grams of host and path; it is
fitted on the driver from a small labelled URL table (a parameter; by default
some 900 rows made by rule from words of general categories) and applied in Arrow batches, so no row is shuffled.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule, and the model's verdict on the empty string.  Repeated rows are judged
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import _seeds, window_hashes

#: Hashed dimensions (a power of two), n-gram sizes in bytes.
DIMS = 1 << 14
SIZES = (3, 4, 5)
#: (host, path, verdict): the rules of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Common words of site names by general category, to be blocked (1) or not (0).
CATEGORIES = (
    (1, "advertising", "ads adserver tracker tracking banner popup click affiliate sponsor promo"),
    (1, "gambling", "casino poker betting bets lottery slots jackpot roulette bingo win"),
    (1, "adult", "adult porn xxx sex cams escort nude erotic hentai fetish"),
    (1, "drugs", "pills viagra cialis meds pharmacy steroids cheap-meds painkillers tramadol xanax"),
    (1, "bulk mail", "spam bulk-mail linkfarm followers getrich payday replica freebies prizes scam"),
    (0, "news", "news herald times journal gazette chronicle tribune observer press courier"),
    (0, "learning", "university college school library academy museum archive lecture science history"),
    (0, "household", "recipes garden kitchen family home cooking baking furniture pets crafts"),
    (0, "travel", "travel city hotels mountains beach railway airport island guide maps"),
    (0, "public", "council ministry parliament hospital police weather transport court agency health"),
    (0, "culture", "music theatre cinema poetry gallery orchestra dance novel photography painting"),
    (0, "technology", "software hardware network database compiler robotics mobile printer forum wiki"),
    (0, "sport", "football tennis cycling running swimming hockey league stadium athletics rowing"),
    (0, "trade", "market farm bakery carpenter insurance logistics factory steel textile orchard"),
    (0, "personal", "diary notes homepage portfolio thoughts letters stories journey sketchbook memories"),
)
#: Addresses around a name, the same for both labels, so that only names teach.
_AROUND = (
    "https://www.{}.com/", "http://{}.org/index.html", "https://blog.{}.net/2021/05/post-17", "http://m.{}.com/en/page?id=3",
    "https://{}.example.org/de/90", "http://www.{}.example.com/fr/65/", "https://shop.{}.example.net/item#top",
)


def site_names() -> list[tuple[str, int]]:
    """(name, label): each word of a category alone, and joined to the next one and the one after three."""
    names = []
    for label, _, words in CATEGORIES:
        words = words.split()
        for i, w in enumerate(words):
            names += [(w, label), *((f"{w}-{words[(i + k) % len(words)]}", label) for k in (1, 3))]
    return names


def labelled_urls(names: Sequence[tuple[str, int]] | None = None) -> tuple[tuple[str, int], ...]:
    """Each site name (default: all) within two of the addresses, with its label."""
    names = site_names() if names is None else names
    return tuple((_AROUND[(i + k) % len(_AROUND)].format(name), label) for i, (name, label) in enumerate(names) for k in (0, 3))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray  # one per hashed n-gram
    bias: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) as the module's rule defines them."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict), both null where no rule fits.  Longest first."""
    name = verdict = None
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def hashed_ngrams(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of every n-gram of every string, with its repeats."""
    data = [b"\x01" + s.replace("\x00", " ").encode("utf-8", "surrogatepass") + b"\x01" for s in strings]
    a = np.frombuffer(b"\x00".join(data) + b"\x00", dtype=np.uint8)
    row = np.repeat(np.arange(len(data)), [len(d) + 1 for d in data])
    ends = np.concatenate(([0], np.cumsum(a == 0)))
    values = _seeds(256, 11)[a]
    rows, grams = [], []
    for n in SIZES:
        h = window_hashes(values, n, stream=20 + n)
        whole = ends[n:] == ends[:len(ends) - n] if len(h) else np.zeros(0, bool)
        rows.append(row[:len(h)][whole])
        grams.append((h[whole] % np.uint64(DIMS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(grams)


def _features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of host and path; the slash that starts a path keeps the two apart."""
    return hashed_ngrams([f"{h}\x02{p}" for h, p in zip(hosts, paths)])


def split_url(url: str | None) -> tuple[str, str]:
    """The Python twin of ``url_parts``, for the labelled table."""
    rest = url.partition("://")[2] if url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fit(labelled: Sequence[tuple[str, int]], steps: int = 800, rate: float = 8.0, ridge: float = 1e-4) -> UrlModel:
    """Logistic regression by full-batch gradient descent; rows are n-gram counts scaled to unit
    length.  The intercept is fitted with the weights.  Deterministic (zero start, fixed steps)."""
    parts = [split_url(u) for u, _ in labelled]
    row, gram = _features([h for h, _ in parts], [p for _, p in parts])
    x = np.zeros((len(parts), DIMS), np.float32)
    np.add.at(x, (row, gram), 1.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    seen = np.flatnonzero(x.any(axis=0))  # other weights stay 0
    x = x[:, seen].astype(float)
    y = np.array([label for _, label in labelled], dtype=float)
    w, bias = np.zeros(len(seen)), 0.0
    for _ in range(steps if len(y) else 0):
        err = 1.0 / (1.0 + np.exp(-(x @ w + bias))) - y
        w -= rate * (x.T @ err / len(y) + ridge * w)
        bias -= err.mean()
    weights = np.zeros(DIMS)
    weights[seen] = w
    return UrlModel(weights, float(bias))


def score(model: UrlModel, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """Probability that each URL is to be blocked."""
    n = len(hosts)
    if not n:
        return np.zeros(0)
    row, gram = _features(hosts, paths)
    key, count = np.unique(row * DIMS + gram, return_counts=True)
    row, gram = key // DIMS, key % DIMS
    dot = np.bincount(row, count * model.weights[gram], minlength=n)
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=n))
    return 1.0 / (1.0 + np.exp(-(dot / np.maximum(norm, 1e-12) + model.bias)))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, block_probability and verdict (columns of
    these names in ``pages`` are replaced)."""
    model = fit(labelled_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def block_probability(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(score(model, host.tolist(), path.tolist()))

    host, path = url_parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "block_probability": block_probability("host", "path")})
    by_model = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(says, by_model))
