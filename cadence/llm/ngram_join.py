"""N-gram Jaccard join and the components of its links.

Every text becomes the set of its distinct ``WIDTH``-word shingles (64-bit
hashes).  Two texts link when ``den * intersection >= num * union``.

1. Texts with equal sets form a class; one member stands for it.
2. Shingles are ordered rare first, by a sketch of document frequencies of fixed
   size over all documents; a shared order is all that correctness needs.  In
   that order only the first n - ceil(num n / den) + 1 shingles of a set of n can
   be the first that a linked pair shares, so only these prefixes are joined.
   A prefix shingle that one class alone has is dropped.
3. Candidate pairs pass the length filter and the positional filter in the join
   and the suffix filter (a lower bound of the symmetric difference from counts
   of the sets' hash ranges) after it; then the sets are intersected, once a
   pair.
4. Linked classes form components.  Since only components are asked for, pairs
   inside one component need no test: in some first rounds each class is tested
   against one class that it shares prefix shingles with (the ``hub`` of a shingle,
   another one each round), which unites copies without looking at all pairs of a
   group; the last round then tests every remaining candidate pair whose classes
   lie in different components.  No candidate is left out (``join_links`` tests all pairs and
   gives the links themselves).  Sets are made again
   from the texts of classes with a candidate pair, none are kept of the others.

Hot shingles: minima per shingle are pre-aggregated; the joins are plain
equi-joins that Spark splits on skew, and the last one is keyed by shingle and,
for hot ones, length band.  Intermediate tables are written under the shared
checkpoint folder.  Two different shingles share a 64-bit hash with a chance of
one in 1.8e19 a pair.

Defined results: null or empty texts, or texts without words, have 0 shingles
and link with nothing (their component is their own id); a text of fewer words
than a shingle is one shingle of all its words; rows that repeat an id are
texts of their own under that id; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import bounded_batches, chunks, mix64, window_hashes, with_text_columns, word_hashes
from cadence.llm.components import connected, near_labels
from cadence.plans.session import bounded_broadcast, materialize, materialize_counted

WIDTH, NUM, DEN = 4, 85, 100
#: Bits of a shingle's hash that name its counter in the frequency sketch, and the
#: slices in which sketches are sent.  A tenfold corpus deserves three bits more.
SKETCH_BITS, SLICES = 22, 64
#: Shingles before a shared one that tell whether a pair was met already.
BEFORE = 8
#: Classes of a shingle above which the last join splits them by length.
HOT = 500
#: Hash ranges of the suffix filter.
RANGES = 64


# --- sets --------------------------------------------------------------------

def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        h, before = word_hashes(part)
        grams = window_hashes(h, width)
        for a, b in zip(before.tolist(), before[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a:b - width + 1]))
            else:
                out.append(window_hashes(h[a:b], b - a, stream=100 + b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set, its size included."""
    total = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(total + np.uint64(len(s)))[0].view(np.int64))


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequencies(documents: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """Rarity of shingles by counter: documents that hold a shingle of the counter, on
    a scale of a few steps an octave.  Each task sends one sketch (a byte a counter,
    at most 255); sums are made in two steps, so that no task reads more than some
    hundred sketches, and the driver gets a byte a counter."""
    bounded_batches(documents.sparkSession)
    size = 1 << SKETCH_BITS
    per = size // SLICES

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size, np.uint8)
        for b in batches:
            sets = shingle_sets([t or "" for t in b.column(0).to_pylist()], width)
            at, n = np.unique(_counter(np.concatenate([np.zeros(0, np.uint64), *sets])), return_counts=True)
            total[at] = np.minimum(total[at] + n, 255)
        rows = [total[i * per:(i + 1) * per].tobytes() for i in range(SLICES)]
        group = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([group] * SLICES, pa.int32()),
                                          pa.array(rows, pa.binary())], names=["slice", "tasks", "counts"])

    def add(kind, scale):
        def total(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
            t = sum(np.frombuffer(c, kind).astype(np.float64) for c in group["counts"])
            return pd.DataFrame({"slice": [key[0]], "counts": [scale(np.minimum(t, 4e9)).tobytes()]})
        return total

    def octaves(t):
        return np.round(4 * np.log2(t + 1.0)).astype(np.uint8)

    sketch = documents.select(F.col(text).cast("string")).mapInArrow(count, "slice int, tasks int, counts binary")
    sketch = sketch.groupBy("slice", "tasks").applyInPandas(add("u1", lambda t: t.astype("<u4")), "slice int, counts binary")
    sketch = sketch.groupBy("slice").applyInPandas(add("<u4", octaves), "slice int, counts binary")
    rarity = np.zeros(size, np.uint8)
    for r in sketch.collect():  # SLICES rows of fixed size
        rarity[r["slice"] * per:(r["slice"] + 1) * per] = np.frombuffer(r["counts"], np.uint8)
    return rarity


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def set_rows(documents: DataFrame, rarity: np.ndarray, text: str, key: str, width: int, num: int, den: int) -> DataFrame:
    """(id, n, class, prefix, ranges) of every row of ``documents``."""
    def run(texts: list[str]):
        sets = shingle_sets(texts, width)
        prefix, ranges = [], []
        for s in sets:
            p = prefix_length(len(s), num, den)
            level = rarity[_counter(s)]
            # s is sorted, so a stable sort by rarity orders by (rarity, hash)
            prefix.append(s[np.argsort(level, kind="stable")[:p]].view(np.int64))
            ranges.append(np.minimum(np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES), 255)
                          .astype(np.uint8).tobytes())
        return [[len(s) for s in sets], [set_id(s) for s in sets], prefix, ranges]

    return with_text_columns(documents.select(F.col(key).alias("id"), F.col(text).alias("_t")), "_t", run,
                             "n int, class bigint, prefix array<bigint>, ranges binary", keep=["id"])


# --- candidates ----------------------------------------------------------------

def _may_link(num: int, den: int, before: Column) -> Column:
    """Length and positional filter on rows with sizes ``a_n``, ``b_n`` and places
    ``a_at``, ``b_at`` of a shared shingle, before which at most ``before`` are shared."""
    na, nb, pa, pb = (F.col(c).cast("long") for c in ("a_n", "b_n", "a_at", "b_at"))
    length = F.least(na, nb) * den >= F.greatest(na, nb) * num
    most = before + 1 + F.least(na - pa - 1, nb - pb - 1)
    return length & (most * (num + den) >= (na + nb) * num)


def _as(df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{name}_{c}") for c in df.columns])


def _hub_pairs(shared: DataFrame, turns: int, num: int, den: int) -> DataFrame:
    """(a, b, turn): for each class and turn, the hub that it shares most prefix
    shingles with.  The hub of a shingle is its class with most shared shingles in
    the prefix, i.e. the copy with fewest changes of its own, to which most others
    are near; every turn picks it from another part of the classes."""
    one = F.struct("class", "n", "at", "rank")
    part = F.pmod(F.xxhash64("class"), F.lit(turns))
    hubs = shared.groupBy("gram").agg(*[
        F.max_by(one, F.when(part == t, F.struct("weight", "class"))).alias(f"hub{t}") for t in range(turns)])
    hubs = hubs.select("gram", F.posexplode(F.array(*[f"hub{t}" for t in range(turns)])).alias("turn", "hub")).filter(
        "hub IS NOT NULL").select("gram", "turn", *[F.col(f"hub.{c}").alias(f"b_{c}") for c in ("class", "n", "at", "rank")])
    met = _as(shared, "a", ("gram",)).join(hubs, "gram").filter(
        (F.col("a_class") != F.col("b_class")) & _may_link(num, den, F.least("a_rank", "b_rank").cast("long")))
    counted = met.groupBy("a_class", "turn", "b_class").agg(F.count("*").alias("shares"))
    best = counted.groupBy("a_class", "turn").agg(F.max_by("b_class", F.struct("shares", "b_class")).alias("hub"))
    return best.groupBy(F.least("a_class", "hub").alias("a"), F.greatest("a_class", "hub").alias("b")).agg(
        F.min("turn").alias("turn"))


def _all_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): every candidate pair of classes in different components.

    Only shingles that lie in several components count.  The join is keyed by
    shingle and, where many classes share it, length band (a set links with sets of
    its own or the next band).  A pair is met at its first common shingle: each row has the ``BEFORE`` shingles
    that come before it in its class, and where two rows have one in common, the
    pair was met there.  Only classes with more can still meet twice."""
    mixed = shared.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                       F.count("*").alias("_n")).filter("low < high")
    rows = shared.drop("rank", "weight").join(mixed.select("gram", (F.col("_n") > HOT).alias("hot")), "gram")
    order = Window.partitionBy("class").orderBy("at")
    rows = rows.withColumns({"rank": F.row_number().over(order) - 1,
                             "before": F.collect_list("gram").over(order.rowsBetween(-BEFORE, -1))})
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_class") < F.col("b_class")))
    ranks = F.when(F.greatest("a_rank", "b_rank") > BEFORE, F.least("a_rank", "b_rank")).otherwise(F.lit(0))
    may_link = (ordered & (F.col("a_component") != F.col("b_component")) & _may_link(num, den, ranks.cast("long"))
                & ~F.arrays_overlap("a_before", "b_before"))
    cold = rows.filter("NOT hot").drop("hot")  # both sides alike, so that one shuffle serves them
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")
    hot = rows.filter("hot").drop("hot").withColumn("band", band)
    next_too = hot.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    keys = ["gram", "band"]
    met = [_as(cold, "a", ("gram",)).join(_as(cold, "b", ("gram",)), "gram"),
           _as(next_too, "a", tuple(keys)).join(_as(hot, "b", tuple(keys)), keys)]
    pairs = [m.filter(may_link).select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
             for m in met]
    return pairs[0].unionByName(pairs[1]).distinct()


# --- verification ---------------------------------------------------------------

def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that pass the suffix filter: the sum of the differences of their
    counts by hash range is not above what linked sets may differ by."""
    bounds, names = classes.select("class", "n", "ranges"), pairs.columns
    both = pairs.join(_as(bounds, "a", ()).withColumnRenamed("a_class", "a"), "a").join(
        _as(bounds, "b", ()).withColumnRenamed("b_class", "b"), "b")

    def suffix(batches):
        import pyarrow as pa

        for x in batches:
            na, nb = (np.array(x.column(c), dtype=np.int64) for c in ("a_n", "b_n"))
            ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int64)
                      for c in ("a_ranges", "b_ranges"))
            need = -(-num * (na + nb) // (num + den))
            near = pa.array(np.abs(ra - rb).sum(axis=1) <= na + nb - 2 * need)
            yield pa.RecordBatch.from_arrays([x.column(c) for c in names], names=names).filter(near)

    return both.select(*names, "a_n", "b_n", "a_ranges", "b_ranges").mapInArrow(suffix, pairs.schema)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of candidate pairs, by exact intersection.  Only the sets of the
    pairs' classes are shuffled."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = sets.join(bounded_broadcast(asked, 500_000), "class", "left_semi")
    sets = sets.groupBy("class").agg(F.first("set").alias("set"))  # a class's rows hold the same set
    tested = pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("set").alias("a_set")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("set").alias("b_set")), "b")

    def intersect(batches):
        import pyarrow as pa

        for x in batches:
            linked = []
            for a, b in zip(x.column("a_set").to_pylist(), x.column("b_set").to_pylist()):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    return tested.select("a", "b", "a_set", "b_set").mapInArrow(intersect, "a bigint, b bigint, linked boolean")


def _candidate_sets(documents: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(class, set) of the classes in ``wanted`` (class, id): the texts are read once
    more and only those whose id falls on a set bit of a bitmap of fixed size are
    cut again, so no text is shuffled."""
    bits, each = 1 << 22, 1 << 15  # a bitmap of Spark's has 2^15 bits
    place = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit(bits - 1))
    wanted = materialize(wanted, "wanted")  # read three times
    maps = [bytes(each // 8)] * (bits // each)
    for r in wanted.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("at")).agg(
            F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(each - 1))).alias("bits")).collect():  # at most bits / each rows
        maps[r["at"]] = bytes(r["bits"])
    packed = b"".join(maps)

    def run(batches):
        import pyarrow as pa

        flags = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        given: set[int] = set()  # a task gives each class once, so repeated rows stay few
        for b in batches:
            asked = b.column("_t").filter(pa.array(flags[np.array(b.column("_p"), dtype=np.int64)]))
            new = {}
            for s in shingle_sets([t or "" for t in asked.to_pylist()], width):
                new.setdefault(set_id(s), s.astype("<u8").tobytes())
            names = [c for c in new if c not in given]
            given.update(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([new[c] for c in names], pa.binary())],
                                             names=["class", "set"])

    docs = documents.select(F.col(key).alias("id"), F.col(text).cast("string").alias("_t")).select("_t", place.alias("_p"))
    found = docs.mapInArrow(run, "class bigint, set binary")
    return found.join(bounded_broadcast(wanted.select("class"), 500_000), "class", "left_semi")


def _shared(classes: DataFrame) -> DataFrame:
    """(gram, class, n, at, rank, weight) of the prefix shingles that another class has as
    well; rank: how many of them come before it in its class; weight: how many the
    class has."""
    prefixes = classes.select("class", F.explode("prefix").alias("gram")).filter("gram IS NOT NULL AND class IS NOT NULL")
    one, other = prefixes.alias("one"), prefixes.alias("other")  # alike, so that one shuffle serves both sides
    met = one.join(other, (F.col("one.gram") == F.col("other.gram")) & (F.col("one.class") != F.col("other.class")), "left_semi")
    at = (F.array_position("prefix", F.col("gram")) - 1).cast("int")
    weight = F.count("*").over(Window.partitionBy("class"))  # a class has no more rows than its prefix
    rows = met.join(classes.select("class", "n", "prefix"), "class").select("gram", "class", "n", at.alias("at"))
    return rows.withColumns({"rank": F.row_number().over(Window.partitionBy("class").orderBy("at")) - 1, "weight": weight})


def _sets_of(pairs: DataFrame, documents: DataFrame, classes: DataFrame, known: DataFrame | None, text: str, key: str,
             width: int) -> DataFrame:
    """(class, set) of the classes in ``pairs`` that ``known`` lacks."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    if known is not None:
        wanted = wanted.join(known.select("class"), "class", "left_anti")
    return _candidate_sets(documents, classes.select("class", "id").join(wanted, "class"), text, key, width)


def _across(pairs: DataFrame, component: DataFrame | None) -> DataFrame:
    """The pairs whose classes lie in different components."""
    if component is None:
        return pairs
    for side in ("a", "b"):
        pairs = pairs.join(component.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c")), side, "left")
    return pairs.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b"))


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after some more links between them: only those that the links
    touch are contracted."""
    if component is None:
        return connected(links)
    ends = links.select("a", "b")
    for side in ("a", "b"):
        known = component.select(F.col("node").alias(side), F.col("component").alias("_c"))
        ends = ends.join(known, side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    joined = connected(ends)
    old = component.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left")
    # a class without a link so far is its own component, and new here
    new = joined.join(component, "node", "left_anti").select("node", "component")
    return old.select("node", F.coalesce("_new", "component").alias("component")).unionByName(new)


def _labelled(classes: DataFrame, component: DataFrame | None) -> DataFrame:
    """Adds ``component``; a class without a link is a component of its own."""
    if component is None:
        return classes.withColumn("component", F.col("class"))
    return classes.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))


# --- the operator ----------------------------------------------------------------

def _prepared(documents: DataFrame, text: str, key: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets, the classes of equal sets, and their shared prefix shingles."""
    bounded_batches(documents.sparkSession)
    rarity = frequencies(documents, text, width)
    rows = materialize(set_rows(documents, rarity, text, key, width, num, den), "sets")
    classes = materialize(rows.filter("n > 0").groupBy("class").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.first("ranges").alias("ranges")), "classes")
    return rows, classes, materialize(_shared(classes), "shared")


def join_links(documents: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
               num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """The join itself, as (members, links): every candidate pair of classes is verified
    once, whatever component it lies in.

    members: (key, n_shingles, class, class_id, n_links) of every row of ``documents``;
    n_links counts the other rows that its text links with, those of its own class
    included.  links: (a, b, a_id, b_id) of every two linked classes, ``a < b``, with
    the smallest key of each.  Rows without shingles have no class and no links."""
    rows, classes, shared = _prepared(documents, text, key, width, num, den)
    pairs = materialize(_near(_all_pairs(_labelled(shared, None), num, den), classes, num, den), "pairs")
    sets = materialize(_sets_of(pairs, documents, classes, None, text, key, width), "candidate-sets")
    linked = materialize(_verified(pairs, sets, num, den).filter("linked").select("a", "b"), "links")

    sizes = rows.filter("n > 0").groupBy("class").agg(F.count("*").alias("rows"))
    ends = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(sizes.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("rows").alias("others"))
    known = classes.select("class", F.col("id").alias("class_id")).join(sizes, "class").join(others, "class", "left")
    named = F.when(F.col("n") > 0, F.col("class")).alias("class")  # the empty set is no class
    members = rows.select("id", "n", named).join(known, "class", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "class", F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("rows") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links"))
    links = linked
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("class").alias(side), F.col("id").alias(f"{side}_id")), side)
    return members, links.select("a", "b", "a_id", "b_id")


def link_components(documents: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                    num: int = NUM, den: int = DEN, hub_rounds: int = 3) -> DataFrame:
    """(key, n_shingles, component_id, class_id) of every row of ``documents``; class_id
    is the smallest key with the same set."""
    rows, classes, shared = _prepared(documents, text, key, width, num, den)
    component: DataFrame | None = None  # (node, component) of the classes linked so far
    none = classes.sparkSession.createDataFrame([], "a bigint, b bigint, linked boolean")
    tested, sets = none, None
    if hub_rounds:
        hubs = materialize(_near(_hub_pairs(shared, hub_rounds, num, den), classes, num, den), "hubs")
        sets = materialize(_sets_of(hubs, documents, classes, None, text, key, width), "candidate-sets")
    for turn in range(hub_rounds):
        # pairs whose classes have one label need no test; labels of a step or two do for that
        seen = materialize(near_labels(tested.filter("linked")), "labels") if turn else None
        pairs = _across(hubs.filter(F.col("turn") == turn), seen)
        tested = tested.unionByName(materialize(_verified(pairs, sets, num, den), "verified"))
    if hub_rounds:
        component = connected(tested.filter("linked"))
    pairs = _all_pairs(_labelled(shared, component), num, den).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest, left = materialize_counted(_near(pairs, classes, num, den), "rest")
    if left["rows"]:
        more = materialize(_sets_of(rest, documents, classes, sets, text, key, width), "candidate-sets")
        found = _verified(rest, more if sets is None else sets.unionByName(more), num, den).filter("linked")
        component = _merged(component, materialize(found, "verified"))

    ids = _labelled(classes.select("class", "id"), component)
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    ids = ids.join(least, "component").select("class", F.col("id").alias("class_id"), "least")
    out = rows.select("id", "n", "class").join(ids, "class", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("least", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))
