"""Merkle manifest of a dataset: leaf digests, subtrees per source, one root, a proof a row.

A row's leaf is the hash of its fields, each as ``bytes:value`` or ``-``.  Leaves of a
source ascend by id; every ``ARITY`` consecutive nodes become the hash of their digests
until one is left, the source's subroot; the subroots, by source, likewise give the root.

Leaf digests are made by Spark's own functions in one pass over the table, so no text
moves.  Rows get their place by a range partitioning on (source, id): the place in a
part plus the rows of the source in earlier parts.  ``ARITY ** height`` consecutive
nodes of a source form a superblock; only digests are grouped by it.  Upwards, a
superblock gives one node of the next layer, and layers are added until every source
has one node.  Downwards, each layer's nodes are cogrouped with the *outer* node of
their superblock (its siblings on the way to the root): one ``applyInPandas`` reduces
the superblock again, joins the inner to the outer part of each proof and folds every
leaf up to the root.  A group never holds more than ``ARITY ** height`` digests,
however many rows a source has.  Every layer is a table on shared storage.

Defined results: null fields hash as ``-``, empty ones as ``0:``; a null source is a
source of its own that comes first; a null id comes before the others of its source.
Rows with one id are ordered by their leaves; equal rows have equal leaves and neighbouring
places.  A lone leaf is its source's subroot, a lone subroot the root.  An empty table
has no rows (and no root).  Further columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.plans.session import bounded_broadcast, materialize

#: Nodes that become one node of the next level.
ARITY = 3
#: Levels of a superblock: 3**7 = 2187 digests of 64 characters.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The hash of the fields in order: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _levels(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of level 0 to ``levels`` of a superblock; a last run may be shorter."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def _path(levels: list[list[str]], place: int) -> list[str]:
    """For each level but the last: the place in the run, then the other nodes of the run."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % ARITY
        out.append(str(place - first) + "".join(nodes[i] for i in range(first, min(first + ARITY, len(nodes))) if i != place))
        place //= ARITY
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    for step in path:
        at = 1 + 64 * int(step[0])
        leaf = _digest(step[1:at] + leaf + step[at:])
    return leaf


def proof(path: list[str]) -> str:
    """The siblings of a path as one text."""
    return "".join(step[1:] for step in path)


# --- places ---------------------------------------------------------------------

def placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place`` (rank in the group by ``order``, from 0) and ``size`` (rows of the
    group), as a table on shared storage.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over
    parts; only a row per part and group is ranked afterwards."""
    sort = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    starts = dealt.groupBy(F.col(group), part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(starts.select(group, "_part", (earlier - F.col("_first")).alias("_shift"),
                                       F.sum("_n").over(w).alias("size")), f"{name}-starts")
    with_part = dealt.withColumn("_part", part)
    return (with_part.join(bounded_broadcast(starts, 200_000), [group, "_part"])
            .withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift"))


# --- the tree -------------------------------------------------------------------

def _block(height: int) -> Column:
    return F.expr(f"place div {ARITY ** height}").alias("block")


def _layers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The given nodes (grp, place, size, node) and, from them, the nodes above each
    superblock, until every group has one.  ``size`` counts a group's nodes in its layer."""
    out = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while most > 1:
        below, step = out[-1], ARITY ** height

        def reduce(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place")
            size = int(group["size"].iloc[0])
            top = _reduced(group["node"].tolist(), min(height, _levels(size)))[-1][0]
            return pd.DataFrame({"grp": [group["grp"].iloc[0]], "place": [int(group["place"].iloc[0]) // step],
                                 "size": [-(-size // step)], "node": [top]})

        keyed = below.select("grp", _block(height), "place", "size", "node")
        above = keyed.groupBy("grp", "block").applyInPandas(reduce, "grp string, place long, size long, node string")
        out.append(materialize(above, "layer"))
        most = -(-most // step)
    return out


def _descend(layer: DataFrame, outer: DataFrame, height: int, finish, schema: str, columns: list[str]) -> DataFrame:
    """Each node of ``layer`` with its whole path to the root, given to ``finish``.

    ``outer`` holds (grp, place, path) of the layer above, a row per superblock; ``finish``
    gets the superblock's rows in order, a path inside it for each, and the outer path."""
    def work(inside: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values("place", ignore_index=True)
        levels = _reduced(inside["node"].tolist(), min(height, _levels(int(inside["size"].iloc[0]))))
        paths = [_path(levels, i) for i in range(len(inside))]
        return finish(inside, paths, list(above["path"].iloc[0]))

    inside = layer.select("grp", _block(height), "place", "size", "node", *columns).groupBy("grp", "block")
    above = outer.select("grp", F.col("place").alias("block"), "path").groupBy("grp", "block")
    return inside.cogroup(above).applyInPandas(work, schema)


def _with_path(inside: pd.DataFrame, paths: list[list[str]], outer: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"grp": inside["grp"], "place": inside["place"], "path": [p + outer for p in paths]})


def _descended(layer: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """(grp, place, path) of every node of ``layer``."""
    return materialize(_descend(layer, outer, height, _with_path, "grp string, place long, path array<string>", []), "paths")


def manifest(docs: DataFrame, changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256 (hash of its
    siblings from the leaf to the root), folded_root and verified.

    ``changed`` is a text (over the columns of ``docs``) to be folded in place of a row's
    own where it is not null: what a reader of altered data would see."""
    fields = [F.col(c) for c in FIELDS]
    now = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_digest([*fields[:-1], changed]))
    leaves = materialize(docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("grp"),
                                     leaf_digest(fields).alias("node"), now.alias("now")), "digests")
    layers = _layers(placed(leaves, "grp", ["doc_id", "node"], "leaves"), height)

    # the subroots are the nodes of one more tree, that of the sources
    subroots = layers[-1].select(F.lit("").alias("all"), "grp", F.col("node").alias("subroot"))
    ranked = materialize(placed(subroots, "all", ["grp"], "subroots").select("grp", "subroot", "place", "size"), "ranked")
    sources = _layers(ranked.select(F.lit("").alias("grp"), "place", "size", F.col("subroot").alias("node")), height)
    crown = sources[-1].first()
    root = F.lit(crown["node"] if crown else None).cast("string")
    paths = sources[-1].select("grp", "place", F.array().cast("array<string>").alias("path"))
    for layer in reversed(sources[:-1]):
        paths = _descended(layer, paths, height)
    top = materialize(ranked.join(paths.select("place", "path"), "place").select("grp", "subroot", "path"), "sources")

    # from the subroots down to the superblocks, then the leaves with what lies outside theirs
    outer = top.select("grp", F.lit(0).cast("long").alias("place"), "path")
    for layer in reversed(layers[1:-1]):
        outer = _descended(layer, outer, height)

    def finish(inside: pd.DataFrame, paths: list[list[str]], above: list[str]) -> pd.DataFrame:
        tail, ends, proofs, folded = proof(above), {}, [], []
        for leaf, now, path in zip(inside["node"], inside["now"], paths):
            proofs.append(_digest(proof(path) + tail))
            node = fold(now if isinstance(now, str) else leaf, path)
            if node not in ends:  # the way from one superblock node to the root is one way
                ends[node] = fold(node, above)
            folded.append(ends[node])
        return pd.DataFrame({"grp": inside["grp"], "id": inside["id"], "leaf": inside["node"],
                             "proof_sha256": proofs, "folded_root": folded})

    named = layers[0].withColumn("id", F.col("doc_id").cast("string"))
    done = _descend(named, outer, height, finish, "grp string, id string, leaf string, proof_sha256 string, folded_root string", ["id", "now"])
    whole = done.join(bounded_broadcast(top.select("grp", "subroot"), 100_000), "grp")
    return whole.select(F.col("id").cast(leaves.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", root.alias("root"),
                        "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
