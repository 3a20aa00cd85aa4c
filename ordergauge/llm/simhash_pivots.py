"""SimHash near-dedup: fingerprints, pivot distance tables, classes of linked documents.

Distinct fingerprints meet in buckets, one for each choice of blocks that stay equal: the 64 bits are cut into blocks,
and as ``radius`` differing bits touch ``radius`` blocks at most, two linked fingerprints agree on all blocks of some
choice. Pivot distances alone would leave all pairs to be looked at, so they work inside a bucket: the distances of its
fingerprints to the reference fingerprints are the pivot table; a pair whose coordinates differ by more than the radius
anywhere is discarded (triangle inequality), the rest is verified bit by bit. A bucket gives the links of a spanning
forest, never all its pairs, and this loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, same_schema, small, with_arrays
from .components import components

BITS = 64
#: hashes whose bits are counted at once
SLICE = 1 << 16
PIVOTS = np.random.default_rng(42).integers(0, 1 << 64, 16, dtype=np.uint64)


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    spans = zip(starts, ends[words - 1 :], strict=False) if len(tokens) >= words else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """The documents with their SimHash as a long. Row by row, without a shuffle; null and empty texts have 0.

    The shingles are runs of ``words`` words of the text with A-Z in lower case, repeats included; a text of fewer words
    is one shingle. Extra columns pass through; a column named as ``into`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            values = batch.column(text).cast(pa.binary()).to_pylist()
            found = [fingerprint_of(x, words) if x else 0 for x in values]
            yield with_arrays(batch, **{into: pa.array(found, pa.int64())})

    return docs.mapInArrow(run, same_schema(docs, **{into: "bigint"}))


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _block_masks(bits: list[int], blocks: int) -> list[int]:
    """The bits, given by their places, cut into blocks of near equal length."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def equal_masks(radius: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """Every choice of blocks that stays equal when at most ``radius`` blocks are touched, as bit masks."""
    parts = _block_masks(list(range(BITS)) if bits is None else bits, blocks)
    return [sum(x) for x in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _spanning(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket's fingerprints at ``radius`` or fewer differing bits."""
    table = np.bitwise_count(found[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    found, table = found[order], table[order]
    links: list[tuple[int, int]] = []
    left = np.arange(len(found))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            first = table[left, 0]
            low, high = np.searchsorted(first, [table[at, 0] - radius, table[at, 0] + radius + 1])
            near = left[low:high]
            near = near[(np.abs(table[near] - table[at]) <= radius).all(axis=1)]
            near = near[np.bitwise_count(found[near] ^ found[at]) <= radius]
            links += [(found[at], found[x]) for x in near]
            reached += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _bucket_links(radius: int):
    """Links within buckets, from rows sorted by (mask, key); a bucket may go over several batches."""

    def links(mask: np.ndarray, key: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(new, len(found)))
        pairs = new[sizes == 2]
        a, b = found[pairs], found[pairs + 1]
        near = np.bitwise_count(a[:, None] ^ PIVOTS).astype(np.int8) - np.bitwise_count(b[:, None] ^ PIVOTS)
        keep = (np.abs(near.astype(np.int8)) <= radius).all(axis=1) & (np.bitwise_count(a ^ b) <= radius)
        out = [np.column_stack([a[keep], b[keep]])]
        for at, n in zip(new[sizes > 2], sizes[sizes > 2], strict=True):
            out.append(np.array(_spanning(found[at : at + n], radius), dtype=np.uint64).reshape(-1, 2))
        rows = np.concatenate(out).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("mask", "key", "fingerprint")])
            if not len(rows):
                continue
            if kept and (kept[0][0, :2] == rows[-1, :2]).all():
                kept.append(rows)  # one bucket so far
                continue
            rows = np.concatenate([*kept, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            kept = [rows[cut:]]
            if cut:
                yield links(rows[:cut, 0], rows[:cut, 1], rows[:cut, 2].astype(np.uint64))
        if kept:
            rows = np.concatenate(kept)
            yield links(rows[:, 0], rows[:, 1], rows[:, 2].astype(np.uint64))

    return run


def links_within(nodes: DataFrame, radius: int = 3, blocks: int = 6, most: int = 1 << 16) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints exactly as all pairs at ``radius`` or fewer bits would.

    ``nodes`` has one row per fingerprint, in a column of that name. A bucket of over ``most`` fingerprints is dealt out
    anew: its free bits are cut into twice as many blocks, which leaves buckets of 2 to the 16 fingerprints at most.
    """
    coarse = equal_masks(radius, blocks)
    every = list(range(BITS))
    finer = [
        [m | x for x in equal_masks(radius, 2 * radius, [b for b in every if not m >> b & 1])] for m in coarse
    ]
    as_array = lambda masks: F.array(*(F.lit(_signed(m)) for m in masks))
    dealt = nodes.select("fingerprint", F.posexplode(as_array(coarse)).alias("choice", "mask"))
    dealt = dealt.withColumn("key", F.expr("fingerprint & mask"))
    large = dealt.groupBy("mask", "key").agg(F.count("*").alias("members")).where(F.col("members") > most)
    sized = dealt.join(large, ["mask", "key"], "left")
    again = (
        sized.where("members is not null")
        .select("fingerprint", F.explode(F.array(*map(as_array, finer))[F.col("choice")]).alias("mask"))
        .withColumn("key", F.expr("fingerprint & mask"))
    )
    buckets = sized.where("members is null").select("mask", "key", "fingerprint").unionByName(
        again.select("mask", "key", "fingerprint")
    )
    return (
        buckets.repartition("mask", "key")
        .sortWithinPartitions("mask", "key")
        .mapInArrow(_bucket_links(radius), "u bigint, v bigint")
    )


def near_duplicates(
    docs: DataFrame, radius: int = 3, words: int = 3, blocks: int = 6, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (long) and ``component_id``, the least id that links reach.

    Fingerprints link at ``radius`` or fewer differing bits. Texts without words have fingerprint 0 and link like any
    other. Rows of equal id are separate documents; a null id counts for no least id, and a class of null ids alone has
    a null one. Columns other than id and text are not looked at. An empty table gives an empty one.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = checkpointed(fingerprints(found, words).select("doc_id", "fingerprint"))
    nodes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    reached = components(links_within(nodes.select("fingerprint"), radius, blocks))
    rooted = nodes.join(reached.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("v", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return found.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One document of each class of ``near_duplicates``, with its columns: the one of least id.

    Of several rows with that id, one of least fingerprint and text stays. Rows without an id link no documents but
    those of their own fingerprint: among these one row stays, unless a row with an id is in the class.
    """
    names = docs.columns
    classes = near_duplicates(docs, radius, words)
    named = classes.where("doc_id = component_id").groupBy("component_id").agg(F.min("fingerprint").alias("chosen"))
    nameless = classes.where("component_id is null").select("component_id", F.col("fingerprint").alias("chosen"))
    chosen = named.unionByName(nameless.distinct()).withColumnsRenamed({"component_id": "__id", "chosen": "__chosen"})
    found = fingerprints(docs, words, into="__fingerprint")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fingerprint") == F.col("__chosen"))
    alike = Window.partitionBy("doc_id", "__fingerprint").orderBy("text")
    kept = found.join(chosen, match, "left_semi").withColumn("__number", F.row_number().over(alike))
    return kept.where("__number = 1").select(*names)
