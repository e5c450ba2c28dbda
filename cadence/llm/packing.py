"""Best-fit packing of tokenised documents with certified bin counts.

1. ``tokenize``: each text's token ids, then the separator id; documents longer
   than a sequence are cut into pieces of full length.  Pieces carry their length
   and a checksum, not their ids.
2. ``pack``: pieces of full length are sequences of their own.  The others are
   dealt to partitions of about ``partition_rows`` pieces, and each partition is
   packed by best-fit decreasing.  Dual-feasible functions give a lower bound of
   the number of sequences that the partition's lengths need; equal numbers
   certify it.  Partitions with a gap give up the documents of their sequences
   that are not full, every partition those of its least filled sequence; these
   documents are dealt anew, to fewer partitions, and packed again.  That repeats
   until no gap is left, one partition holds them all, or ``rounds`` is reached;
   a round that saves no sequence is dropped.

A partition's size is fixed, so memory is bounded and only short rows
(document, piece, length) are shuffled.  Rounds are written under the shared
checkpoint folder.

Defined results: null text is empty, i.e. the separator alone; every input row
is packed, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import with_text_columns
from cadence.llm.token_counts import byte_letters
from cadence.plans.session import materialize

CAPACITY = 2048
#: Words remembered by a task before it starts anew (some 200 bytes a word).
REMEMBERED = 400_000

# Characters whose words can be cut here just as the tokenizer cuts them: no
# normalisation changes them and both agree on what is space, letter and number.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-ɏ‐-‧]|<\\|")
_NUMBERS = "\xb2\xb3\xb9\xbc\xbd\xbe"
_SPLIT = re.compile(rf"[^\W\d_{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)|[\d{_NUMBERS}]|(?:[^\s\w]|_)+")


class PartIds(dict):
    """Letters, numeral or marks, in lower case -> ids as little-endian unsigned
    32-bit bytes, by the vocabulary's merges."""

    def __init__(self, model) -> None:
        super().__init__()
        self.merge = model.tokenize
        self.letter = {b: c for c, b in byte_letters().items()}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.clear()
        spelt = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode("utf-8")))
        ids = array("I", [t.id for t in self.merge(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        self[part] = ids.tobytes()
        return self[part]


class WordIds(dict):
    """Word between spaces, in lower case -> the ids of its parts."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.part = PartIds(self.tokenizer.model).__getitem__

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = b"".join(map(self.part, _SPLIT.findall(word)))
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a text.  One of common characters is cut at spaces, which no
        token crosses, and looked up; the tokenizer does others from end to end."""
        if _OTHER.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, read once a worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenize(documents: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id",
             capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece of every document."""
    end = np.array([separator], dtype="<u4").tobytes()

    def start():
        ids, step = WordIds(vocabulary).text, 4 * capacity

        def run(texts: list[str]):
            data = [ids(t) + end for t in texts]
            return [[len(d) // 4 for d in data],
                    [[zlib.crc32(d[i:i + step]) for i in range(0, len(d), step)] for d in data]]
        return run

    found = with_text_columns(documents, text, start, "_n long, _crc array<long>", keep=[key], per_task=True)
    pieces = found.select(key, "_n", F.posexplode("_crc").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    return pieces.select(key, "piece", start.alias("start"),
                         F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("length"), "ids_crc32")


# --- bounds and packing of one partition --------------------------------------

def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest sequences that ``lengths`` can need, by dual-feasible functions.

    A dual-feasible function f maps lengths so that any that fit together keep a
    sum of at most the capacity; the sum of f over all lengths, divided by the
    capacity and rounded up, is a bound.  Tried are U_e (lengths above capacity-e
    count whole, those below e nothing) for each e, u_k (rounding to k+1 parts)
    for some k, and u_k after U_e."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    tokens = np.cumsum(count * x)
    number = np.cumsum(count)
    e = np.arange(capacity // 2 + 1)
    below = np.where(e > 0, tokens[np.maximum(e - 1, 0)], 0)  # lengths under e
    above = number[-1] - number[capacity - e]  # lengths over capacity-e
    u = tokens[capacity - e] - below + above * capacity
    best = int(-(-u.max() // capacity))
    for k in range(1, 33):
        parts = (k + 1) * x
        f = np.where(parts % capacity == 0, x * k, parts // capacity * capacity)  # of k * capacity
        for cut in (0, *(capacity // d for d in range(2, 9))):
            g = np.where(x > capacity - cut, capacity * k, np.where(x < cut, 0, f))
            best = max(best, int(-(-(count * g).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length: longest first, each into the fullest
    sequence that still takes it.  A bit set of free room finds that sequence."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        sequence[i], offset[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return sequence, offset


def pack_partition(lengths: np.ndarray, capacity: int = CAPACITY):
    """(sequence, offset, fill of that sequence, gap to the bound, is least filled)."""
    sequence, offset = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(sequence, lengths).astype(np.int64)
    gap = len(fill) - lower_bound(lengths, capacity)
    return sequence, offset, fill[sequence], gap, sequence == int(np.argmin(fill))


def _dealt(rest: DataFrame, turn: int, parts: int) -> DataFrame:
    """``rest`` with a partition for each row.  Within a batch the rows are dealt in
    the order of their lengths, so that all partitions get lengths alike."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["length", "_row"], kind="stable", ignore_index=True)
            if len(b):
                first = (int(b["_row"].min()) * 0x9E3779B1 + turn * 7919) % parts
                yield b.assign(_part=(first + np.arange(len(b))) % parts)

    return rest.select("_row", "length").mapInPandas(run, "_row long, length long, _part long")


def _packed(rest: DataFrame, turn: int, parts: int, capacity: int) -> DataFrame:
    """``rest`` dealt to ``parts`` partitions and packed in each."""
    def run(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        sequence, offset, fill, gap, least = pack_partition(group["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"_row": group["_row"], "length": group["length"], "_part": int(key[0]),
                             "_seq": sequence, "offset": offset, "_fill": fill, "_gap": gap, "_least": least})

    return _dealt(rest, turn, parts).groupBy("_part").applyInPandas(
        run, "_row long, length long, _part long, _seq long, offset long, _fill long, _gap long, _least boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_rows: int = 50_000, rounds: int = 4) -> DataFrame:
    """``pieces`` (with a ``length`` column) with sequence_id and offset."""
    table = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    rest = table.filter(F.col("length") < capacity).select("_row", "length")
    rows, settled = rest.count(), []
    gives_up = F.col("_least") | ((F.col("_gap") > 0) & (F.col("_fill") < capacity))
    before = None  # sequences that the documents of this round had in the one before
    for turn in range(rounds):
        if not rows:
            break
        parts = -(-rows // partition_rows)
        packed = materialize(_packed(rest, turn, parts, capacity).withColumn(
            "sequence_id", (F.lit(turn).cast("long") * (1 << 56)) + F.col("_part") * (1 << 24) + F.col("_seq")), "packed")
        made = packed.filter("offset = 0").count()
        if before is not None and made >= before[0]:
            settled.append(before[1])
            break
        again = packed.filter(gives_up)
        if parts == 1 or turn == rounds - 1:
            settled.append(packed)
            break
        settled.append(packed.filter(~gives_up))
        stats = again.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        rest, rows, before = again.select("_row", "length"), stats[0], (stats[1], again)
    own = table.filter(F.col("length") >= capacity).select(
        "_row", (F.lit(-1).cast("long") - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = own
    for part in settled:
        placed = placed.unionByName(part.select("_row", "sequence_id", "offset"))
    return table.join(placed, "_row").drop("_row")
