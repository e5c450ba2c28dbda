"""Helpers shared by the training-data operators.

Words are always ``[^\\x20\\x09-\\x0D]+``: maximal runs of characters other than
space, tab, LF, VT, FF and CR.  In UTF-8 these six are single bytes that never
occur inside another character, so words can be cut on the encoded bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text handled by one vectorised step (one longer text is one step).
CHUNK_BYTES = 1 << 18
#: Rows per Arrow batch: with texts of a few KB a batch stays below some MB, and
#: with 100 KB texts below 50 MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers get at most ``rows`` rows at a time, so that a worker's
    memory does not grow with the table."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``mod`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


# --- 64-bit hashing of words, vectorised over bytes -------------------------

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element, modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int, stream: int) -> np.ndarray:
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(base + np.uint64(stream * 0x632BE59BD9B4E019 & _MASK))


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of a byte with A-Z lower-cased, value with case kept, is a word byte)."""
    kept = _seeds(256, 1)
    lower = kept.copy()
    lower[65:91] = kept[97:123]
    word = np.ones(256, dtype=bool)
    word[list(_SPACE_BYTES)] = False
    lower[~word] = kept[~word] = 0
    return lower, kept, word


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    """Odd multiplier of each place in a word: products of one odd constant."""
    p = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _places(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n - 1).bit_length()))


def chunks(texts: list[str | None]):
    """Runs of texts of about ``CHUNK_BYTES``: (first index, encoded texts)."""
    part: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(b) > CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, i
        part.append(b)
        size += len(b) + 1
    if part:
        yield first, part


def word_spans(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts joined by LF, word starts, word ends, words before text i)."""
    a = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
    is_word = _byte_tables()[2][a]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    ends_of_text = np.cumsum([len(b) + 1 for b in part])
    before = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    return a, starts, ends, before


def word_hashes(part: list[bytes], lower: bool = True):
    """(64-bit hash of every word, words before text i).  A-Z count as a-z if ``lower``."""
    a, starts, ends, before = word_spans(part)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    lens = ends - starts
    values = _byte_tables()[0 if lower else 1][a]
    bounds = np.concatenate(([0], starts[1:], [len(a)]))
    place = np.arange(len(a)) - np.repeat(starts, np.diff(bounds))
    np.maximum(place, 0, out=place)
    values *= _places(int(place.max()) + 1)[place]
    h = np.add.reduceat(values, starts)
    return mix64(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), before


def window_hashes(h: np.ndarray, width: int, stream: int = 7) -> np.ndarray:
    """Hash of every ``width`` consecutive entries of ``h`` (fewer entries: none)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    coeff = _seeds(width, stream) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k:k + n] * coeff[k]
    return mix64(out)


# --- running numpy over texts -----------------------------------------------

def with_text_columns(df: DataFrame, text: str, fn, fields: str, keep: list[str] | None = None,
                      per_task: bool = False) -> DataFrame:
    """``df`` with new columns computed from its text column, in Arrow batches.

    ``fn`` gets the texts of a batch (null as empty) and returns one sequence per
    field of ``fields`` (a DDL string); with ``per_task`` it is called once a task,
    without arguments, to make that function, so that what it remembers ends with
    the task.  ``keep`` names the columns to carry along
    untouched (all by default); those that clash with a new name, in any case, are
    replaced by the new column."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    bounded_batches(df.sparkSession)
    new = _parse_datatype_string(fields)
    taken = {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    plain = text in kept and dict(df.dtypes)[text] == "string"  # no second copy of the text is sent
    given = df.select(*[F.col(f"`{c}`") for c in kept], *([] if plain else [F.col(f"`{text}`").cast("string").alias("_text_")]))
    schema = StructType(given.schema.fields[:len(kept)] + new.fields)
    arrow, at = to_arrow_schema(new), kept.index(text) if plain else len(kept)

    def run(batches):
        work = fn() if per_task else fn
        for b in batches:
            columns = work([t or "" for t in b.column(at).to_pylist()])
            made = [pa.array(c, type=f.type, from_pandas=True) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(list(b.columns[:len(kept)]) + made, names=kept + arrow.names)

    return given.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, rows: int, group: str | None = None) -> DataFrame:
    """At most ``rows`` different keys (of each ``group`` value), always the same
    ones: those whose hashed key is smallest.

    A count gives the share of the hash range that holds a little more than
    ``rows`` keys, so only those few are ever shuffled and sorted, however many
    rows or tasks there are.  With repeated keys the sample is smaller."""
    from pyspark.sql import Window

    from cadence.plans.session import bounded_broadcast

    names = df.columns
    if group is None:
        grouped = df.withColumns({"_g": F.lit(0), "_size": F.lit(df.count())})
    else:
        sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"))
        grouped = df.withColumn("_g", F.col(group)).join(bounded_broadcast(sizes, 100_000), "_g")
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    few = grouped.withColumn("_p", place).filter(
        F.col("_p") * F.col("_size") <= rows + 6.0 * rows ** 0.5 + 50).distinct()
    w = Window.partitionBy("_g").orderBy("_p", key)
    return few.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows).select(*names)


def ngram_counts(texts: list[str], byte_class: np.ndarray, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams, one row of ``dims`` (a power of two) a text.

    ``byte_class`` gives the class of each byte, 0 to 254; a run of one class 0
    counts like any other n-gram."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    for first, part in chunks(texts):
        a = np.frombuffer(b"\xff".join(part) + b"\xff", dtype=np.uint8)
        lens = np.array([len(p) + 1 for p in part])
        row = np.repeat(np.arange(len(part), dtype=np.int64) * dims, lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(a)) - 1  # bytes up to the end of the text
        c = byte_class[a].astype(np.uint32) + np.uint32(1)
        total = np.zeros(len(part) * dims, dtype=np.int64)
        for n in sizes:
            m = len(a) - n + 1
            if m <= 0:
                continue
            code = np.full(m, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ c[k:k + m]
            bucket = (code * np.uint32(0x9E3779B1)) >> shift
            whole = left[:m] >= n
            total += np.bincount(row[:m][whole] + bucket[whole], minlength=len(total))
        out[first:first + len(part)] = total.reshape(len(part), dims)
    return out


def sparse_bytes(counts: np.ndarray) -> list[bytes]:
    """Each row's non-zero entries as bytes, for sending a bounded sample around."""
    out = []
    for r in counts:
        i = np.flatnonzero(r)
        out.append(i.astype("<u2").tobytes() + r[i].astype("<f4").tobytes())
    return out


def dense_rows(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), dtype=np.float32)
    for r, b in zip(out, packed):
        n = len(b) // 6
        r[np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, 2 * n)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
