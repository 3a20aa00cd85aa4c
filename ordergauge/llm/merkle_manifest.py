"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, a proof for every document.

Every document is a leaf, every ``FAN`` consecutive nodes make one of the next level. The leaves of a source are cut
into superblocks of ``FAN`` to the ``depth`` neighbours. Upwards, a task reduces the superblocks it holds to one node
each, and these nodes are leaves of the same step again until each source has one. Downwards, the nodes of a superblock
are cogrouped with what they need from outside of it, the siblings on the way from the superblock to the root: there the
local levels are reduced once more, joined with the outer siblings to a proof, and folded to the root.

A place in a source comes from sorted ranges: rows are numbered in their range, and running counts of the ranges, a few
numbers for each, say where it begins. No task sees more than a range or a few superblocks of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

FAN = 16
#: leaves that meet in one call, in whole superblocks
TOGETHER = 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "tree string, at bigint, left array<string>, right array<string>, subroot string"
PROVEN = "id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else UTF-8 byte count, colon, value."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is one whose text is changed to try the proofs: 5 divides the CRC-32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number, and each row's place among those of its tree in this task."""
    task, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        tree = np.array(batch.column("tree").to_pylist(), dtype=object)
        if not len(tree):
            continue
        starts = np.flatnonzero(np.concatenate([[tree[0] != last], tree[1:] != tree[:-1]]))
        begin = np.full(len(tree), -seen, np.int64)
        for at in starts:
            begin[at:] = at
        place = np.arange(len(tree)) - begin
        last, seen = tree[-1], int(place[-1]) + 1
        added = [pa.array(np.full(len(tree), task, np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "place"])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``at``, the place in their ``tree`` by the given columns, and ``levels``, those above them to its top.

    Rows that are equal in tree and order are interchangeable; a seeded random number deals them to several ranges.
    """
    keys = ["tree", *order]
    slim = checkpointed(rows.withColumn("__deal", F.rand(12)))
    ranges = slim.repartitionByRange(*keys, "__deal").sortWithinPartitions(*keys, "__deal").drop("__deal")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = checkpointed(ranges.mapInArrow(_numbered, f"{kind}, part int, place bigint"))
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), F.sum("n").over(whole).alias("total")
    )
    # ceil of the logarithm, as the digits of the last place
    levels = F.when(F.col("total") > 1, F.length(F.conv(F.col("total") - 1, 10, FAN))).otherwise(0)
    found = numbered.join(begins, ["tree", "part"])
    found = found.select(*rows.columns, (F.col("begin") + F.col("place")).alias("at"), levels.cast("int").alias("levels"))
    return checkpointed(found)


def _binned(nodes: DataFrame, depth: int, bins: int) -> DataFrame:
    block = F.expr(f"at div {FAN**depth}")
    return nodes.withColumns({"block": block, "bin": F.pmod(F.xxhash64("tree", block), F.lit(bins))})


def reduced(digests: list[str], times: int) -> list[list[str]]:
    """The digests and the levels above them."""
    levels = [digests]
    for _ in range(times):
        below = levels[-1]
        levels.append([digest_of("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands to the left and to the right in the run of a node and of each node above it, below the last level."""
    left, right = [], []
    for level in levels[:-1]:
        start = at // FAN * FAN
        left.append("".join(level[start:at]))
        right.append("".join(level[at + 1 : start + FAN]))
        at //= FAN
    return left, right


def _blocks(nodes: pd.DataFrame) -> Iterator[tuple[str, int, pd.DataFrame]]:
    for (tree, block), rows in nodes.sort_values(["tree", "at"]).groupby(["tree", "block"], sort=False):
        yield tree, int(block), rows


def _up(nodes: DataFrame, depth: int, bins: int) -> DataFrame:
    """One node for each superblock: (tree, at, digest, levels)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, block, own in _blocks(rows):
            above = int(own["levels"].iloc[0])
            times = min(depth, above)
            out.append((tree, block, reduced(own["digest"].tolist(), times)[-1][0], above - times))
        return pd.DataFrame(out, columns=["tree", "at", "digest", "levels"])

    slim = _binned(nodes.select("tree", "at", "digest", "levels").where("levels > 0"), depth, bins)
    return slim.groupBy("bin").applyInPandas(run, "tree string, at bigint, digest string, levels int")


def _cogrouped(nodes: DataFrame, outer: DataFrame, depth: int, bins: int, each, kind: str) -> DataFrame:
    """``each(tree, block, rows, levels, outer)`` gives rows of ``kind`` for the nodes of one superblock."""
    names = [part.split()[0] for part in kind.split(", ")]

    def run(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        of = {(r.root_of, int(r.block)): r for r in around.itertuples(index=False)}
        out = []
        for tree, block, own in _blocks(rows):
            levels = reduced(own["digest"].tolist(), min(depth, int(own["levels"].iloc[0])))
            out += each(tree, block, own, levels, of[tree, block])
        return pd.DataFrame(out, columns=names)

    # all under new names, for a cogroup mixes up columns that both sides have from the same frame
    near = outer.select(
        F.col("tree").alias("root_of"), F.col("at").alias("block"), *(F.col(c).alias(c) for c in ("left", "right", "subroot"))
    )
    near = near.withColumn("bin", F.pmod(F.xxhash64("root_of", "block"), F.lit(bins)))
    return _binned(nodes, depth, bins).groupBy("bin").cogroup(near.groupBy("bin")).applyInPandas(run, kind)


def _paths(tree, block, own, levels, outer) -> list[tuple]:
    out = []
    for place, at in enumerate(own["at"]):
        left, right = siblings(levels, place)
        out.append((tree, int(at), [*left, *outer.left], [*right, *outer.right], outer.subroot))
    return out


def _proven(tree, block, own, levels, outer) -> list[tuple]:
    """A row of ``PROVEN`` for each leaf: its siblings up to the root hashed together, and the fold with them."""
    out = []
    for place, (doc, leaf, changed) in enumerate(zip(own["id"], own["digest"], own["changed"], strict=True)):
        left, right = siblings(levels, place)
        left, right = [*left, *outer.left], [*right, *outer.right]
        proof = digest_of("".join(a + b for a, b in zip(left, right, strict=True)))
        node = changed or leaf
        for a, b in zip(left, right, strict=True):
            node = digest_of(a + node + b)
        out.append((doc, leaf, outer.subroot, proof, node))
    return out


class _Forest:
    """The trees over placed nodes (tree, at, digest, levels, ...), tier by tier: a tier's superblocks are the next's nodes."""

    def __init__(self, nodes: DataFrame, depth: int):
        self.depth = depth
        self.bins = max(1, nodes.count() // TOGETHER)
        self.tiers = [nodes]
        high = nodes.agg(F.max("levels")).first()[0] or 0
        while high > 0:
            self.tiers.append(checkpointed(_up(self.tiers[-1], depth, self.bins)))
            high -= depth

    def tops(self) -> DataFrame:
        """(tree, digest, tier): the last node of each tree."""
        parts = [t.where("levels = 0").select("tree", "digest", F.lit(k).alias("tier")) for k, t in enumerate(self.tiers)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def down(self, above: DataFrame, each, kind: str) -> DataFrame:
        """``each`` over the first tier, from (tree, left, right, subroot, tier): the way from each tree's top to the root."""
        found = None
        for k in range(max(0, len(self.tiers) - 2), -1, -1):
            ends = above.where(F.greatest(F.col("tier") - 1, F.lit(0)) == k)
            outer = ends.select("tree", F.lit(0).cast("bigint").alias("at"), "left", "right", "subroot")
            if found is not None:
                outer = outer.unionByName(found)
            nodes = self.tiers[k]
            if k:
                # the tops themselves have no superblock around them
                found = _cogrouped(nodes.where("levels > 0"), outer, self.depth, self.bins, _paths, PATH)
            else:
                found = _cogrouped(nodes, outer, self.depth, self.bins, each, kind)
        return found


def proofs(docs: DataFrame, depth: int = 3) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id, null ids first; rows of one id by their digest, and rows equal in that too are
    interchangeable. Sources ascend by their bytes, the null one first. ``proof_sha256`` is the digest of the siblings
    from the leaf to the root, of nothing if there are none. ``folded_root`` folds the leaf with them, a changed leaf
    where ``tampered`` says so: the same row with A-Z of its text in lower case; rows without an id are never changed,
    and null and lower-case texts have nothing to change. ``verified``: whether it is the root. Only the columns of
    ``FIELDS`` count. ``depth`` is how many levels a superblock has. An empty table gives an empty one.
    """
    lowered = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").alias("number"),
        leaf_digest(*map(F.col, FIELDS)).alias("digest"),
        F.when(tampered(F.col("doc_id")), leaf_digest(*lowered)).alias("changed"),
    )
    leaves = placed(leaves, "number", "digest")
    forest = _Forest(leaves.select("*", F.col("number").cast("string").alias("id")), depth)
    tops = checkpointed(forest.tops())
    over = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    top = _Forest(over, depth)
    ends = top.tops()
    root = ends.select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")
    none = F.array().cast("array<string>")
    ways = top.down(ends.select("tree", none.alias("left"), none.alias("right"), root.alias("subroot"), "tier"), _paths, PATH)
    named = ways.select("at", "left", "right").join(over.select("at", "name"), "at").drop("at")
    above = tops.join(named.withColumnRenamed("name", "tree"), "tree").withColumnRenamed("digest", "subroot")
    found = forest.down(checkpointed(above.select("tree", "left", "right", "subroot", "tier")), _proven, PROVEN)
    return found.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
