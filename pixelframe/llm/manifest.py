"""Merkle manifest of a corpus by persistent path-copying trees.

Every row is a leaf. The leaves of a source, in order, are the first level of its tree; every three consecutive nodes, or what is left at the
end, become one of the next level until one is left, the subroot. The subroots in order of their sources make a tree of the same kind, with the root.

Trees are cut into aligned blocks of 3**LEVELS neighbouring nodes, so that a block's nodes have their ancestors of LEVELS levels to
themselves. On the way up a task makes the trees of blocks, whose roots are the nodes of the next round, until each tree has one. On
the way down a block gets what lies beside its root on the way to the top, as one row, and gives each of its nodes the siblings on the
whole path. A tampered leaf makes a version of its block's tree: a new leaf and copies of its ancestors, all other nodes
are shared with the untampered version, which stays. The version goes on above its block by copies of the ancestors there.

Positions come from a sort by ranges of (source, doc_id, leaf, row): a source or an id with many rows, all equal even, spans as many ranges
as it needs, and a row's place is that in its range plus the sizes of the ranges before it. No task has more than a range or a few blocks.

Defined results. Null fields count as `-`, so a null text and an empty one differ. Null sources come first, null ids first in their
source, of equal ids the lesser leaf digest first; equal rows are leaves of their own. One leaf is its own subroot, one subroot is the root.
A tampered row whose text has no line feed, or is null, stays verified. An empty table gives an empty table. Of the input the columns named in
FIELDS are read, others are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .minhash import by_group, starts_of

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Nodes under one parent, and levels of a block.
ARITY, LEVELS = 3, 7


def digest_of(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Hex digest of the fields, each `-` or its UTF-8 byte count, `:` and its value."""
    text = [F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


class Versions:
    """Nodes of one tree, never changed once made. A version is the node at its top; versions share what they do not copy."""

    def __init__(self, leaves: list[str], height: int):
        self.digest: list[str] = list(leaves)
        self.levels = [list(range(len(leaves)))]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([self._parent(below[k : k + ARITY]) for k in range(0, len(below), ARITY)])

    def _parent(self, children: list[int]) -> int:
        self.digest.append(digest_of("".join(self.digest[c] for c in children)))
        return len(self.digest) - 1

    @property
    def root(self) -> str:
        return self.digest[self.levels[-1][0]]

    def replaced(self, leaf: int, digest: str) -> str:
        """The top of a new version with another leaf: a copy of each ancestor."""
        self.digest.append(digest)
        new, at = len(self.digest) - 1, leaf
        for level in self.levels[:-1]:
            first = at - at % ARITY
            new = self._parent([new if first + k == at else c for k, c in enumerate(level[first : first + ARITY])])
            at //= ARITY
        return self.digest[new]

    def siblings(self, leaf: int) -> list[str]:
        """What stands before and after the path's node, level by level."""
        out, at = [], leaf
        for level in self.levels[:-1]:
            first = at - at % ARITY
            out.append("".join(self.digest[c] for c in level[first:at]))
            out.append("".join(self.digest[c] for c in level[at + 1 : first + ARITY]))
            at //= ARITY
        return out


def folded(digest: str, path: list[str]) -> str:
    """`digest` carried up along pairs of what stands before and after it."""
    for k in range(0, len(path), 2):
        digest = digest_of(path[k] + digest + path[k + 1])
    return digest


def _height(n: int, levels: int) -> int:
    """Levels of a block above its nodes, in a tree that has `n` nodes on their level."""
    out = 0
    while n > 1 and out < levels:
        n, out = -(-n // ARITY), out + 1
    return out


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` with pos, the place in the tree by `order` (unique), and n, the number of the tree's nodes."""
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("range", F.shiftright("at", 33))
    runs = ranged.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("tree", "range", "first", before.alias("before"), F.sum("size").over(tree).alias("n")), "runs")
    return ranged.join(runs, ["tree", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}").alias("block")


def _tops(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["tree", "block"]):
            starts = starts_of(t, ["tree", "block"])
            tree, block, n, leaves = (t[c].to_pylist() for c in ("tree", "block", "n", "digest"))
            rows = [(tree[a], block[a], -(-n[a] // ARITY**levels), Versions(leaves[a:b], _height(n[a], levels)).root) for a, b in zip(starts, starts[1:], strict=False)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["tree", "pos", "n", "digest"])

    return run


def grown(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The levels of blocks above nodes(tree, pos, n, digest), themselves included, up to one node a tree."""
    levels, n = [nodes], nodes.agg(F.max("n")).head()[0] or 1
    while len(levels) == 1 or n > 1:
        rows = levels[-1].select("tree", _block(height), "pos", "n", "digest")
        levels.append(written(_dealt(rows).mapInArrow(_tops(height), "tree string, pos long, n long, digest string"), "tops"))
        n = -(-n // ARITY**height)
    return levels


def _paths(carried: list[str], levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["tree", "block"]):
            starts = starts_of(t, ["tree", "block"])
            n, leaves, altered, above, subroot = (t[c].to_pylist() for c in ("n", "digest", "altered", "path", "subroot"))
            paths, tops, subs, keep = [], [], [], []
            for a, b in zip(starts, starts[1:], strict=False):  # the first row of a block has what lies above it
                tree, up = Versions(leaves[a + 1 : b], _height(n[a + 1], levels)), above[a]
                keep += range(a + 1, b)
                for k in range(b - a - 1):
                    own = tree.siblings(k)
                    new = altered[a + 1 + k]
                    tops.append(folded(folded(leaves[a + 1 + k], own) if new is None else tree.replaced(k, new), up))
                    paths.append(own + up)
                    subs.append(subroot[a])
            rows = t.take(pa.array(keep, pa.int64())).combine_chunks()
            for batch in pa.table(
                {**{c: rows[c] for c in ("tree", "pos", "digest", *carried)}, "subroot": pa.array(subs, pa.string()), "path": pa.array(paths, pa.list_(pa.string())), "folded": pa.array(tops, pa.string())}
            ).to_batches():
                yield batch

    return run


def descended(nodes: DataFrame, heads: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """Each node with the path to the top: tree, pos, digest, `carried`, subroot, path, folded.

    heads: tree, pos, subroot, path of the blocks' own nodes on the level above. `folded` is the top of the node's version, or of its own path.
    """
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in carried}
    none = lambda kind: F.lit(None).cast(kind)
    rows = nodes.select(
        "tree", _block(levels), "pos", "n", "digest", F.col("altered") if "altered" in nodes.columns else none("string").alias("altered"),
        *carried, none("string").alias("subroot"), none("array<string>").alias("path"),
    )
    above = heads.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), none("long").alias("n"), none("string").alias("digest"), none("string").alias("altered"),
        *(none(k).alias(c) for c, k in kinds.items()), "subroot", "path",
    )
    named = "".join(f"`{c}` {k}, " for c, k in kinds.items())
    return _dealt(rows.unionByName(above)).mapInArrow(_paths(carried, levels), f"tree string, pos long, digest string, {named}subroot string, path array<string>, folded string")


def prove(docs: DataFrame, tampered: Column | None = None, new_text: Column | None = None, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified of every row of docs(doc_id, source, lang, n_chars, text).

    path: what stands before and after the row's node on each level up to the root. folded_root: the top recomputed from the leaf along its path; where
    `tampered` holds, from the leaf that `new_text` in place of the text makes. verified: it equals the root.
    """
    docs = docs.select(*FIELDS)
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    altered = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_of("doc_id", "source", "lang", "n_chars", new_text))
    leaves = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*FIELDS).alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("row")
    )
    levels = grown(written(placed(written(leaves, "leaves"), ["doc_id", "digest", "row"]), "placed"), height)
    sources = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = grown(written(placed(sources, ["name"]), "sources"), height)
    heads = forest[-1].select("tree", "pos", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("path"))
    for level in reversed(forest[:-1]):
        heads = written(descended(level, heads, ["name"] if level is forest[0] else [], height), "paths")
    heads = heads.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path")
    for level in reversed(levels[1:-1]):
        heads = written(descended(level, heads, [], height), "paths")
    root = forest[-1].head()
    out = descended(levels[0], heads, ["doc_id"], height).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def digest(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """`prove`, where rows whose id has an even CRC-32 lose the line feeds of their texts; the path as its digest."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = prove(docs, odd, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")), height)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root", "verified")
