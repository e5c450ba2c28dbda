"""Small documents and brute-force twins shared by the operator tests."""

from __future__ import annotations

import random
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def prose(seed: int, n: int, stems=("river", "stone", "walk", "light", "green", "under", "paper", "house", "seven")) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "er"]) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows):
    """(id, text[, lang]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)
