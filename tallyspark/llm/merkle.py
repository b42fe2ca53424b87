"""Merkle manifest of a dataset by time-forward processing: one tree for each group, one tree over the groups' roots.

A node's label is its level and place. Children send their digests forward in time, to the label of their parent; a reversed sweep
sends proofs back, so that each leaf gets the digests beside its path up to the root. The queue of messages that this
takes is external: between bands of BAND levels it is Spark's sorted shuffle, which deals the messages by group and block
(the subtree of arity**BAND places below one label), sorts them by label and spills. Inside a band a task works on one block after
the other with a small heap of the messages under way. So a task holds one block, whatever the size of a group; a group with a third
of all rows has as many blocks as its rows demand, and only tables of ids and digests are moved, never texts.

Places are given by range partitions, ranks inside them and prefix sums of their counts; no task sees a whole group.

Nulls and odd input: a null value is hashed as `-`; the null group comes first; in a group leaves ascend by the order column, null
first, and then by digest, so repeated rows are leaves of their own and ties do not matter; a leaf alone in its group is the group's
root; with one group, that group's root is the root; very long texts are hashed in the JVM, whole; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import stored

BAND, ARITY, OUT_ROWS = 8, 3, 1000


def leaf_digest(*values: Column) -> Column:
    """Hexadecimal sha256 of the values, each as `-` if null, else as its number of UTF-8 bytes, a colon and itself."""
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(field(c.cast("string")) for c in values)).cast("binary"), 256)


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def climb(leaves: list[str], height: int, arity: int) -> tuple[list[tuple[int, list[int]]], list[str]]:
    """Forward sweep over one block: (label, children's labels) of the nodes above `leaves` by ascending label; all digests by label."""
    base, width = [0], len(leaves)
    for _ in range(height):
        base.append(base[-1] + width)
        width = -(-width // arity)
    digests, nodes = list(leaves), []
    parent = lambda level, place: base[level + 1] + place // arity
    queue = [(parent(0, i), i) for i in range(len(leaves))] if height else []  # in order, so a heap
    level = 0
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[1])
        digests.append(node_digest([digests[c] for c in children]))
        nodes.append((label, children))
        while level + 1 < height and label >= base[level + 2]:
            level += 1
        if level + 1 < height:
            heapq.heappush(queue, (parent(level + 1, label - base[level + 1]), label))
    return nodes, digests


def descend(nodes: list[tuple[int, list[int]]], digests: list[str], above: tuple[list[str], list[str]]) -> list[tuple[list[str], list[str]]]:
    """Reversed sweep: for every leaf, the digests before and after it at each level, joined, up to the root.

    `above` is what stands beside the way from the block's top to the root.
    """
    beside = {len(digests) - 1: above}
    for label, children in reversed(nodes):
        before, after = beside.pop(label)
        own = [digests[c] for c in children]
        for k, child in enumerate(children):
            beside[child] = (["".join(own[:k]), *before], ["".join(own[k + 1 :]), *after])
    return [beside[i] for i in range(len(beside))]


def heights(size: Column, band: int, arity: int) -> Column:
    """Levels above `size` nodes, at most a band."""
    return reduce(lambda found, k: F.when(size <= arity**k, F.lit(k)).otherwise(found), reversed(range(band)), F.lit(band))


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """`nodes` (stored) with `place` in its group, by `order`, and `size` of the group."""
    part = F.shiftright("at", 33)
    dealt = stored(nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    parts = dealt.groupBy(F.col(group).alias("own"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"below": F.coalesce(F.sum("held").over(before), F.lit(0)), "size": F.sum("held").over(Window.partitionBy("own"))})
    joined = dealt.join(parts, F.col(group).eqNullSafe(F.col("own")) & (part == F.col("part")))
    return joined.withColumn("place", F.col("below") + F.col("at") - F.col("first")).drop("own", "part", "at", "first", "held", "below")


NODES = "`group` {kind}, place long, size long, digest string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column("group").to_pylist(), batch.column("block").to_pylist()))
        cuts = [k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else last)]
        last = keys[-1] if keys else last
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_block(nodes: DataFrame, band: int, arity: int) -> DataFrame:
    block = nodes.withColumns({"block": F.expr(f"place div {arity**band}"), "height": heights(F.col("size"), band, arity)})
    return block.repartition("group", "block").sortWithinPartitions("group", "block", "place")


def forest(nodes: DataFrame, kind: str, band: int = BAND, arity: int = ARITY) -> tuple[DataFrame, list[DataFrame]]:
    """(root of each group: group, digest; the nodes under each band, lowest first) of nodes: group, place, size, digest and others."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block in _blocks(batches):
            first = block.slice(0, 1).to_pylist()[0]
            digests = climb(block.column("digest").to_pylist(), first["height"], arity)[1]
            out.append((first["group"], first["block"], -(-first["size"] // arity**band), digests[-1]))
            if len(out) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types(block))], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types(block))], names)

    names = ["group", "place", "size", "digest"]
    types = lambda block: [block.schema.field("group").type, pa.int64(), pa.int64(), pa.string()]
    bands, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        nodes = stored(_by_block(nodes.select(names), band, arity).mapInArrow(tops, NODES.format(kind=kind)), "nodes")
        bands.append(nodes)
        most = -(-most // arity**band)
    return nodes.select("group", "digest"), bands[:-1] if len(bands) > 1 else []


def proofs(bands: list[DataFrame], above: DataFrame, band: int = BAND, arity: int = ARITY) -> DataFrame:
    """Every lowest node with `before`, `after` and the other columns of `above`, which holds those of each group's root."""
    carried = [c for c in above.columns if c not in ("group", "before", "after")]
    above = above.withColumn("place", F.lit(0).cast("long"))
    for nodes in reversed(bands):
        kept = [c for c in nodes.columns if c not in ("place", "size")]
        names = [*kept, "place", *carried, "before", "after"]
        fields = {f.name: f for f in (*nodes.schema, *above.schema)}
        schema = StructType([fields[c] for c in names])
        down = _descent(names, carried, arity)
        # the message from above comes before the nodes of its block
        told = above.withColumns({"block": F.col("place"), "place": F.lit(-1).cast("long")})
        both = nodes.withColumns({"block": F.expr(f"place div {arity**band}"), "height": heights(F.col("size"), band, arity)}).drop("size").unionByName(told, allowMissingColumns=True)
        dealt = both.repartition("group", "block").sortWithinPartitions("group", "block", "place")
        above = dealt.mapInArrow(down, schema)
        if nodes is not bands[0]:
            above = stored(above.drop("digest"), "paths")
    return above


def _descent(names: list[str], carried: list[str], arity: int):
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            told, own = block.slice(0, 1).to_pylist()[0], block.slice(1)
            nodes, digests = climb(own.column("digest").to_pylist(), own.column("height")[0].as_py(), arity)
            paths = descend(nodes, digests, (told["before"], told["after"]))
            for a in range(0, len(paths), OUT_ROWS):
                part = own.slice(a, OUT_ROWS)
                made = dict(zip(("before", "after"), zip(*paths[a : a + OUT_ROWS])))
                made |= {c: [told[c]] * part.num_rows for c in carried}
                columns = [pa.array(made[c], part.schema.field(c).type) if c in made else part.column(c).combine_chunks() for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return down


def fold(digest: Column, before: Column, after: Column) -> Column:
    """The root that `digest` leads to with the digests beside its path."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), digest, lambda low, x: F.sha2(F.concat(x["b"], low, x["a"]).cast("binary"), 256))


def merkle_manifest(leaves: DataFrame, group_col: str, order_col: str, digest_col: str = "leaf", band: int = BAND, arity: int = ARITY) -> DataFrame:
    """`leaves` with `subroot` (root of its group), `root`, `before` and `after` (digests beside the path to `root`, joined by level).

    Columns of these names in `leaves` are replaced, others stay.
    """
    kind = leaves.schema[group_col].dataType.simpleString()
    extra = [c for c in leaves.columns if c not in (group_col, order_col, digest_col, "subroot", "root", "before", "after")]
    own = leaves.select(F.col(group_col).alias("group"), F.col(order_col).alias("order"), F.col(digest_col).alias("digest"), F.struct(F.lit(0).alias("_"), *extra).alias("extra"))
    nodes = stored(placed(stored(own, "leaves"), "group", "order", "digest"), "placed")
    subroots, bands = forest(nodes, kind, band, arity)
    groups = stored(subroots.withColumn("name", F.col("group")), "subroots")
    tree = stored(placed(groups.select(F.lit(0).alias("group"), "name", "digest"), "group", "name"), "placed")
    top, above = forest(tree, "int", band, arity)
    start = top.select("group", F.col("digest").alias("root"), F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"))
    if above:
        start = proofs(above, start, band, arity)
    else:
        start = tree.drop("size", "place").join(F.broadcast(start), "group")
    start = stored(start.select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "root", "before", "after"), "paths")
    if bands:
        found = proofs(bands, start, band, arity)
    else:
        found = nodes.join(start.withColumnRenamed("group", "own"), F.col("group").eqNullSafe(F.col("own")))
    out = found.select(F.col("group").alias(group_col), F.col("order").alias(order_col), F.col("digest").alias(digest_col), "extra", "subroot", "root", "before", "after")
    return out.select(group_col, order_col, digest_col, *(F.col("extra")[c].alias(c) for c in extra), "subroot", "root", "before", "after")
