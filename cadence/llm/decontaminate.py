"""Benchmark decontamination by templates.

Texts are canonicalised to template tokens: words in lower case without marks at
their ends; numbers (with a unit that follows: quantities) and names become typed
placeholders.  Every window of ``WIDTH`` template tokens of a document is hashed
and hash-joined with the windows of the benchmark items; an item shorter than
that is one window of its own length.  A capitalised word at the start of a sentence
may be a name or not, so windows with such words have a second template in which
they are names; windows with numbers or names also have a literal key of their
tokens as they stand, in lower case.  A placeholder's original is the value of
its slot.  Windows that line up (same distance between place in the document and
place in the item, give or take ``DRIFT`` words put in or left out) are one
alignment, and its slots must be consistent: a value of the item stands for the one
value in the document that it has at half of its places at least.  Windows with
another value do not count, those with the item's own values always do.  So a
question with other numbers or names is caught, a text that merely has the same
shape is not.

A document is contaminated by an item if the windows that count in an alignment are
``RUN``, or half of the item's windows if that is fewer, or if they cover as many
words of the item as that many windows in a row do (edits cut windows, not words).

Documents are read once, in Arrow batches.  Only windows whose hash falls on a
set bit of a bitmap of the benchmark's hashes (fixed size) leave the batch; the
exact join follows, on either side's size, so a large benchmark only lets more
windows through.  Nothing of the documents is collected.

Defined results: null or empty texts match nothing; items of fewer than
``SHORT`` tokens match nothing, since any text may hold them; windows with fewer
than ``LEAST`` literal words, and items of fewer than ``LEAST`` tokens, match by
their literal key only; repeated rows of a document give the
result of one; an empty benchmark or document table gives an empty result.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import WORD, _seeds, mix64, window_hashes, with_text_columns
from cadence.plans.session import materialize

WIDTH = 8
#: Windows of one alignment that make a document contaminated.
RUN = 6
#: Words put in or left out within an alignment.
DRIFT = 2
#: Fewest literal words of a template window.
LEAST = 4
#: Fewest tokens of an item.
SHORT = 3
#: Bits of the bitmap that keeps most windows from leaving their batch.
BITS = 1 << 22
#: Words remembered by a task before it starts anew.
REMEMBERED = 400_000

PLAIN, NUMBER, QUANTITY, UNIT, NAME, NOTHING = range(6)
#: How a window was hashed.
TEMPLATE, NAMED, OWN = range(3)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion dozen half".split())
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years c f k degree degrees percent dollar "
    "dollars cent cents euro euros mph kph hz khz mhz ghz w kw v a j kj n pa kpa mol cal kcal kb mb gb tb".split())
_MARKS = string.punctuation + "\u2018\u2019\u201c\u201d\u00ab\u00bb\u2013\u2014\u2026\u00bf\u00a1\u00b7\u2022"
_SENTENCE_ENDS = re.compile("[.!?:\u2026]")
_NUMERAL = re.compile(r"\d[\d.,:/]*(?:st|nd|rd|th)?")
_WITH_UNIT = re.compile(r"(\d[\d.,:/]*)([^\W\d_]+)")


def word_kind(word: str) -> tuple[int, str, bool]:
    """(kind if nothing around it says otherwise, value, ends a sentence)."""
    core = word.strip(_MARKS)
    if core == word:
        ends = False
    else:
        ends = bool(_SENTENCE_ENDS.search(word, len(word.rstrip(_MARKS))))
        if not core:
            return NOTHING, "", ends
    low = core.lower()
    if low in NUMBER_WORDS:
        return NUMBER, low, ends
    if low in UNITS:
        return UNIT, low, ends
    if core.isalpha():
        return NAME if core != low and len(core) > 1 and core.istitle() else PLAIN, low, ends
    if _NUMERAL.fullmatch(core):
        return NUMBER, low, ends
    glued = _WITH_UNIT.fullmatch(core)
    if glued and glued[2].lower() in UNITS:
        return QUANTITY, f"{glued[1]} {glued[2].lower()}", ends
    return NAME if core.istitle() and core[0].isupper() else PLAIN, low, ends


def _with_unit(number, unit):
    """The hash of a quantity from those of its parts."""
    return mix64(number + mix64(unit))


def _own_hash(value: str) -> int:
    number, _, unit = (value.encode("utf-8", "surrogatepass")).partition(b" ")
    h = [np.array([xxhash.xxh3_64_intdigest(x)], np.uint64) for x in (number, unit)]
    return int(_with_unit(*h)[0] if unit else h[0][0])


class Kinds(dict):
    """word -> row of the columns that hold its kind, hash, value and sentence end."""

    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.kind, self.ends, self.hash = array("b"), array("b"), array("Q")
        self.value: list[str] = []

    def __missing__(self, word: str) -> int:
        kind, value, ends = word_kind(word)
        self[word] = row = len(self.value)
        self.kind.append(kind)
        self.ends.append(ends)
        self.hash.append(_own_hash(value) if kind == QUANTITY else xxhash.xxh3_64_intdigest(
            value.encode("utf-8", "surrogatepass")))
        self.value.append(value)
        return row


_PLACEHOLDER = _seeds(8, 61)  # the hash of each kind of placeholder


class Templates:
    """The template tokens of a batch of texts, one text after the other."""

    def __init__(self, texts: list[str], known: Kinds | None = None) -> None:
        known = Kinds() if known is None else known
        if len(known) > REMEMBERED:
            known.start()
        words = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in map(WORD.findall, texts)]
        rows = np.concatenate(words) if words else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        kind, ends = np.array(known.kind, np.int64)[rows], np.array(known.ends, np.int64)[rows]
        ended = np.cumsum(ends) - ends  # sentences ended before each word
        real = kind != NOTHING
        rows, text, kind, ended = rows[real], text[real], kind[real], ended[real]
        same_text = np.diff(text, prepend=-1) == 0
        starts = ~same_text | (np.diff(ended, prepend=-1) > 0)
        maybe = (kind == NAME) & starts
        kind[maybe] = PLAIN
        unit = np.full(len(rows), -1)
        follows = np.flatnonzero((kind[1:] == UNIT) & (kind[:-1] == NUMBER) & same_text[1:])
        kind[follows], unit[follows] = QUANTITY, rows[follows + 1]
        keep = np.ones(len(rows), bool)
        keep[follows + 1] = False
        self.rows, self.text, self.kind, self.unit = rows[keep], text[keep], kind[keep], unit[keep]
        self.maybe = maybe[keep]
        self.kind[self.kind == UNIT] = PLAIN
        known_hash = np.array(known.hash, np.uint64)
        own = known_hash[self.rows]
        self.hash = mix64(np.where(self.kind == PLAIN, own, _PLACEHOLDER[self.kind]))
        self.named = np.where(self.maybe, mix64(_PLACEHOLDER[NAME:NAME + 1]), self.hash)
        units = np.flatnonzero(self.unit >= 0)
        own[units] = _with_unit(own[units], known_hash[self.unit[units]])
        self.own = mix64(own)
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.literal = np.concatenate(([0], np.cumsum(self.kind == PLAIN)))
        self.starts = np.concatenate(([0], np.cumsum(self.maybe)))
        self.value = known.value

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first token, form) of every window of one text: as a template with
        enough literals, as one with names at sentence starts, and by its own tokens
        where no template has the same hash."""
        n = max(len(self.hash) - width + 1, 0)
        within = self.text[:n] == self.text[width - 1:width - 1 + n]
        literal = self.literal[width:width + n] - self.literal[:n]
        starts = self.starts[width:width + n] - self.starts[:n]
        fits = ((TEMPLATE, self.hash, literal >= LEAST), (NAMED, self.named, (starts > 0) & (literal - starts >= LEAST)),
                (OWN, self.own, (literal < width) | (width < LEAST)))
        out = []
        for form, tokens, fit in fits:
            h, at = window_hashes(tokens, width, stream=70 + width), np.flatnonzero(within & fit)
            out.append((h[at].view(np.int64), at, np.full(len(at), form)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def places(self, at: int, width: int, form: int = 0) -> list[int]:
        """The tokens of a window that are placeholders; in its own form, that might be."""
        return [i for i in range(at, at + width) if self.kind[i] != PLAIN or form != TEMPLATE and self.maybe[i]]

    def original(self, i: int) -> str:
        value = self.value[self.rows[i]]
        return f"{value} {self.value[self.unit[i]]}" if self.unit[i] >= 0 else value

    def slots(self, at: int, width: int, form: int = 0) -> list[str] | None:
        """The originals of a window's placeholders; none where it holds its own tokens."""
        return None if form == OWN else [self.original(i) for i in self.places(at, width, form)]


_WINDOW = "array<struct<hash: bigint, place: int, slots: array<string>>>"
_ITEM_WINDOW = "array<struct<hash: bigint, place: int, slots: array<struct<at: int, value: string>>>>"


def item_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item, windows, width, hash, item_place, item_slots) of every benchmark window."""
    def run(texts: list[str]):
        t = Templates(texts)
        size = np.diff(t.first)
        out: list[list] = [[] for _ in texts]
        for width in range(SHORT, WIDTH + 1):
            for h, at, form in zip(*(x.tolist() for x in t.windows(width))):
                i = int(t.text[at])
                if min(int(size[i]), WIDTH) == width:
                    start = int(t.first[i])
                    out[i].append({"hash": h, "place": at - start, "slots": [
                        {"at": j - start, "value": t.original(j)} for j in t.places(at, width, form)]})
        return [np.minimum(size, WIDTH), out]

    found = with_text_columns(benchmark, text, run, f"width int, _w {_ITEM_WINDOW}", keep=[key])
    return found.select(F.col(key).alias("item"), F.size("_w").alias("windows"), "width", F.inline("_w")).select(
        "item", "windows", "width", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))


def _bit(h):
    return np.asarray(h).view(np.uint64) & np.uint64(BITS - 1)


def bitmap(items: DataFrame) -> np.ndarray:
    """One bit for each hash modulo ``BITS``: at most BITS / 64 rows are collected."""
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    word = items.groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in word:
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def document_windows(documents: DataFrame, widths: tuple[int, ...], bits: np.ndarray, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """(doc, hash, place, slots) of the document windows that may be a benchmark's."""
    packed = np.packbits(bits)

    def start():
        known, bits = Kinds(), np.unpackbits(packed).astype(bool)

        def run(texts: list[str]):
            t = Templates(texts, known)
            out: list[list] = [[] for _ in texts]
            for width in widths:
                h, at, forms = t.windows(width)
                maybe = bits[_bit(h)]
                for x, a, form in zip(h[maybe].tolist(), at[maybe].tolist(), forms[maybe].tolist()):
                    i = int(t.text[a])
                    out[i].append({"hash": x, "place": a - int(t.first[i]), "slots": t.slots(a, width, form)})
            return [out]
        return run

    found = with_text_columns(documents, text, start, f"_w {_WINDOW}", keep=[key], per_task=True)
    return found.filter(F.size("_w") > 0).select(F.col(key).alias("doc"), F.inline("_w"))


def counted(met: list[tuple[int, list[tuple[int, str, str]]]]) -> tuple[set[int], int]:
    """(places of the windows that count, changed slots in them) of one alignment, given
    each window's place in the item and its slots (place, item's value, document's)."""
    votes: dict[str, dict[str, list[int]]] = {}
    for _, slots in met:
        for at, was, now in slots:
            votes.setdefault(was, {}).setdefault(now, []).append(at)
    stands = {}
    for was, by in votes.items():
        now = max(by, key=lambda v: (len(set(by[v])), len(by[v]), v == was, v))
        if 2 * len(set(by[now])) >= len({at for v in by.values() for at in v}):
            stands[was] = now
    kept = [w for w in met if all(now == was or stands.get(was) == now for _, was, now in w[1])]
    return {place for place, _ in kept}, len({(was, now) for _, slots in kept for _, was, now in slots if was != now})


def _decided(alignments: DataFrame, run: int) -> DataFrame:
    """(doc, item, n, windows, changed) of the alignments that contaminate."""
    names = ["doc", "item", "n", "windows", "changed"]

    def decide(batches):
        import pyarrow as pa

        for b in batches:
            found, n, changed = [], [], []
            sizes = zip(b.column("windows").to_pylist(), b.column("width").to_pylist(), b.column("met").to_pylist())
            for i, (windows, width, met) in enumerate(sizes):
                places, other = counted([(w["item_place"], [(p["item_slots"]["at"], p["item_slots"]["value"], p["slots"])
                                                            for p in w["pairs"]]) for w in met])
                need = min(run, -(-windows // 2))
                covered = len({k for p in places for k in range(p, p + width)})
                if len(places) >= need or covered >= need + width - 1:
                    found.append(i)
                    n.append(len(places))
                    changed.append(other)
            rows = b.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("item"), pa.array(n, pa.int32()),
                                              rows.column("windows"), pa.array(changed, pa.int32())], names=names)

    kinds = dict(alignments.dtypes)
    return alignments.mapInArrow(decide, f"doc {kinds['doc']}, item {kinds['item']}, n int, windows int, changed int")


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                 item_text: str = "text", item_key: str = "item_id", run: int = RUN) -> DataFrame:
    """(key, item_key, windows, item_windows, changed_slots): one row per document
    and benchmark item that it holds."""
    items = materialize(item_windows(benchmark, item_text, item_key), "benchmark-windows")
    widths = tuple(sorted(r["width"] for r in items.select("width").distinct().collect()))  # at most six
    docs = document_windows(documents, widths, bitmap(items), text, key)
    shift = F.col("place") - F.col("item_place")
    # a row for each alignment that the window may be part of; one holds at most DRIFT + 1 times the item's windows
    met = docs.join(items, "hash").select(
        "doc", "item", "windows", "width", "item_place",
        # a window met by its own tokens has the item's values
        F.arrays_zip("item_slots", F.when(F.size("slots") > 0, F.col("slots")).otherwise(F.col("item_slots.value")).alias(
            "slots")).alias("pairs"),
        F.explode(F.sequence(shift, shift + DRIFT)).alias("shift"))
    lined = met.groupBy("doc", "item", "windows", "width", "shift").agg(
        F.collect_set(F.struct("item_place", "pairs")).alias("met"))
    return (_decided(lined, run).groupBy("doc", "item")
            .agg(F.max("n").alias("windows"), F.max("windows").alias("item_windows"), F.min("changed").alias("changed_slots"))
            .select(F.col("doc").alias(key), F.col("item").alias(item_key), "windows", "item_windows", "changed_slots"))
