"""Line dedup with sharded cuckoo filters over exact reference counts.

The state is three tables. ``postings`` has the distinct (key, document) pairs; ``references`` counts the documents of
each key exactly and names the first; ``filters`` has, per shard of the keys, a cuckoo filter of the keys that two or
more documents hold. Adding documents inserts the keys that reach a second document, deleting documents removes those
that fall back to one, so the state after a deletion is that of an index which never saw the document.

Dropping repeated lines sends every line past its shard's filter first. What the filter knows, a few false hits
included, is joined with the exact counts, which decide.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, same_schema, small, with_arrays

SLOTS = 4
KICKS = 500
#: part of the cells that keys may fill before a filter is built anew
FULL = 0.85
#: keys that one shard should hold, and copies of a filter among which a shard's lines are dealt
SHARD_KEYS = 500_000
SALTS = 8


class Cuckoo:
    """A cuckoo filter of 16-bit marks, four to a bucket; what finds no place is kept whole in ``stash``."""

    def __init__(self, table: np.ndarray, stash: set[int] | None = None):
        self.table, self.stash = table, stash or set()

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, table: bytes, stash) -> Cuckoo:
        return cls(np.frombuffer(table, "<u2").reshape(-1, SLOTS).copy(), {int(x) for x in stash})

    def bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark, first and second bucket of each 64-bit hash. Either bucket leads to the other by the mark alone."""
        mark = ((hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        first = hashes & np.uint64(len(self.table) - 1)
        return mark, first.astype(np.int64), self._other(first.astype(np.int64), mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        spread = mark.astype(np.uint64) * np.uint64(0x5BD1E995)
        return bucket ^ (spread & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(hashes)
        found = (self.table[first] == mark[:, None]).any(axis=1) | (self.table[second] == mark[:, None]).any(axis=1)
        if self.stash:
            found |= np.isin(hashes, np.fromiter(self.stash, np.uint64, len(self.stash)))
        return found

    def insert(self, hashes: np.ndarray) -> None:
        choose = random.Random(len(hashes))
        for whole, mark, first, second in zip(hashes, *self.places(hashes), strict=True):
            path = []
            at = first if (self.table[first] == 0).any() else second
            while True:
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
                if len(path) == KICKS:
                    for bucket, slot, old in reversed(path):
                        self.table[bucket, slot] = old
                    self.stash.add(int(whole))
                    break
                slot = choose.randrange(SLOTS)
                path.append((at, slot, self.table[at, slot]))
                self.table[at, slot], mark = mark, self.table[at, slot]
                at = int(self._other(np.array([at]), np.array([mark]))[0])

    def delete(self, hashes: np.ndarray) -> None:
        for whole, mark, first, second in zip(hashes, *self.places(hashes), strict=True):
            if int(whole) in self.stash:
                self.stash.remove(int(whole))
                continue
            for at in (first, second):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


@dataclass(frozen=True)
class LineIndex:
    """postings (key, doc_id); references (key, documents, owner); filters (shard, cells, stash)."""

    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    least: int


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit key of a line: ASCII white space off both ends, A-Z in lower case; None below ``least`` code points."""
    line = line.strip().lower()
    if len(line) < least or len(line) < 4 * least and len(line.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(line)


def _postings(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id), each key once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            keys, rows = [], []
            for row, value in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if value:
                    own = {line_key(x, least) for x in value.split(b"\n")} - {None}
                    keys += own
                    rows += [row] * len(own)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids], ["key", "doc_id"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"key binary, doc_id {slim.schema['doc_id'].dataType.simpleString()}")


def _references(postings: DataFrame) -> DataFrame:
    """Documents of each key and the first of them. Null ids are one document, which comes last."""
    return postings.groupBy("key").agg(
        (F.count("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("documents"),
        F.min("doc_id").alias("owner"),
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8")[::2] if len(keys) else np.zeros(0, np.uint64)


def _row(shard, cuckoo: Cuckoo) -> pd.DataFrame:
    stash = [x - (1 << 64) if x >> 63 else x for x in sorted(cuckoo.stash)]
    return pd.DataFrame({"shard": [shard], "cells": [cuckoo.bytes()], "stash": [stash]})


FILTER = "shard int, cells binary, stash array<bigint>"


def _filters(references: DataFrame, shards: int, room: int = 1) -> DataFrame:
    """One filter for each shard that has a repeated key, for ``room`` times as many."""

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cuckoo = Cuckoo.sized(room * len(rows))
        cuckoo.insert(_hashes(rows["key"].sort_values()))
        return _row(shard[0], cuckoo)

    repeated = references.where("documents > 1").select("key", _shard(shards).alias("shard"))
    return repeated.groupBy("shard").applyInPandas(build, FILTER)


def build_index(
    docs: DataFrame, least: int = 10, shards: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> LineIndex:
    """The index of all lines of ``docs`` with at least ``least`` code points.

    Null and empty texts hold no line. Rows with equal ids count as one document, and so do rows without an id, which
    come after all others. The number of shards follows the number of repeated keys unless it is given.
    """
    postings = checkpointed(_postings(docs, least, doc_id, text).distinct())
    references = checkpointed(_references(postings))
    if shards is None:
        shards = 16 + references.where("documents > 1").count() // SHARD_KEYS
    return LineIndex(postings, references, checkpointed(_filters(references, shards)), shards, least)


def _changed_filters(index: LineIndex, old: DataFrame, new: DataFrame, references: DataFrame) -> DataFrame:
    """The filters after the counts of some keys went from those in ``old`` to those in ``new``.

    A shard whose keys would fill more than ``FULL`` of its filter's cells gets a new one, twice as large as they need,
    from the exact counts in ``references``.
    """
    wanted = references.where("documents > 1").groupBy(_shard(index.shards).alias("shard")).agg(F.count("*").alias("n"))
    cells = index.filters.select("shard", F.expr("octet_length(cells) div 2").alias("cells"))
    outgrown = checkpointed(wanted.join(cells, "shard").where(F.col("n") > FULL * F.col("cells")).select("shard"))
    kept = index.filters.join(outgrown, "shard", "left_anti")
    rebuilt = _filters(references.join(outgrown, _shard(index.shards) == F.col("shard"), "left_semi"), index.shards, 2)
    was = old.where("documents > 1").select("key", F.lit(True).alias("was"))
    now = new.where("documents > 1").select("key", F.lit(True).alias("now"))
    moved = was.join(now, "key", "full").where("was is null or now is null")
    moved = moved.select("key", F.col("now").isNotNull().alias("enters"), _shard(index.shards).alias("shard"))
    moved = moved.join(outgrown, "shard", "left_anti")

    def change(shard: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(cells):
            cuckoo = Cuckoo.read(cells["cells"][0], [int(x) % (1 << 64) for x in cells["stash"][0]])
        else:
            cuckoo = Cuckoo.sized(2 * len(rows))
        if len(rows):
            rows = rows.sort_values("key")
            cuckoo.delete(_hashes(rows["key"][~rows["enters"]]))
            cuckoo.insert(_hashes(rows["key"][rows["enters"]]))
        return _row(shard[0], cuckoo)

    # all under new names, for a cogroup mixes up columns that both sides have from the same frame
    moved = moved.select(F.col("shard").alias("of"), F.col("key").alias("key"), F.col("enters").alias("enters"))
    changed = kept.groupBy("shard").cogroup(moved.groupBy("of")).applyInPandas(change, FILTER)
    return changed.unionByName(rebuilt)


def _moved(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with new postings. Only the counts of ``touched`` keys are made anew."""
    touched = touched.select("key").distinct()
    before = index.references.join(touched, "key", "left_semi")
    after = checkpointed(_references(postings.join(touched, "key", "left_semi")))
    references = checkpointed(index.references.join(touched, "key", "left_anti").unionByName(after))
    filters = checkpointed(_changed_filters(index, before, after, references))
    return LineIndex(postings, references, filters, index.shards, index.least)


def add_documents(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with the lines of ``docs`` added."""
    new = checkpointed(_postings(docs, index.least, doc_id, text).distinct())
    return _moved(index, checkpointed(index.postings.unionByName(new).distinct()), new)


def delete_documents(index: LineIndex, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The index without the documents whose ids are in ``ids``: as if they had never been added."""
    gone = ids.select(F.col(doc_id).alias("gone")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("gone"))
    taken = checkpointed(index.postings.join(gone, match, "left_semi"))
    return _moved(index, checkpointed(index.postings.join(gone, match, "left_anti")), taken)


def _known(index: LineIndex, postings: DataFrame) -> DataFrame:
    """The postings that pass their shard's filter: a superset of those with a repeated key.

    Filters and lines of a shard meet in one partition, the filter first, so a task holds one filter at a time and lets
    the lines stream by. A shard with a very common line is dealt out among ``SALTS`` copies of its filter.
    """
    kind = postings.schema["doc_id"].dataType
    filters = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "cells", "stash")
    filters = filters.select("*", F.lit(None).cast("binary").alias("key"), F.lit(None).cast(kind).alias("doc_id"))
    lines = postings.select(
        _shard(index.shards).alias("shard"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt"),
        F.lit(None).cast("binary").alias("cells"),
        F.lit(None).cast("array<bigint>").alias("stash"),
        "key",
        "doc_id",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cuckoo = None, None
        for batch in batches:
            place = np.column_stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()])
            cells, keep = batch.column("cells"), np.zeros(len(place), bool)
            heads = np.flatnonzero(cells.is_valid().to_numpy(zero_copy_only=False))
            news = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            cuts = sorted({0, *(heads + 1).tolist(), *heads.tolist(), *news.tolist(), len(place)})
            for low, high in zip(cuts, cuts[1:], strict=False):
                if cells[low].is_valid:
                    stash = [x % (1 << 64) for x in batch.column("stash")[low].as_py()]
                    held, cuckoo = tuple(place[low]), Cuckoo.read(cells[low].as_py(), stash)
                elif held == tuple(place[low]):
                    keep[low:high] = cuckoo.contains(_hashes(batch.column("key").slice(low, high - low).to_pylist()))
            yield batch.filter(pa.array(keep)).select(["key", "doc_id"])

    return (
        filters.unionByName(lines)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("cells").isNull())
        .mapInArrow(run, f"key binary, doc_id {kind.simpleString()}")
    )


def drop_repeated_lines(
    docs: DataFrame, index: LineIndex, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` before dropping and ``n_dropped``.

    A line whose key two or more documents of the index hold is dropped everywhere but in the one of the smallest id;
    that one keeps all its lines. The other lines stay, joined by line feeds. Null and empty texts are one empty line,
    and come out as the empty text. Extra columns pass through, except that columns with the three names are replaced.
    Rows of equal id lose the same lines. An empty table gives an empty one. Short lines are never dropped.
    """
    return _without(docs, index, _known(index, _postings(docs, index.least, doc_id, text)), doc_id, text)


def _without(docs: DataFrame, index: LineIndex, held: DataFrame, doc_id: str, text: str) -> DataFrame:
    repeated = index.references.where("documents > 1").select("key", "owner")
    drops = held.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = drops.groupBy(F.col("doc_id").alias("__drop_id")).agg(F.collect_set("key").alias("__drop"))
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    joined = docs.select(*names).join(drops, F.col(doc_id).eqNullSafe(F.col("__drop_id")), "left").drop("__drop_id")
    least = index.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            texts, counts, dropped = [], [], []
            values = batch.column(text).cast(pa.binary()).to_pylist()
            for value, drop in zip(values, batch.column("__drop").to_pylist(), strict=True):
                lines = (value or b"").split(b"\n")
                gone = set(drop or ())
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield with_arrays(
                batch.select(names),
                kept_text=pa.array(texts, pa.binary()).cast(pa.string()),
                n_lines=pa.array(counts, pa.int64()),
                n_dropped=pa.array(dropped, pa.int64()),
            )

    added = {"kept_text": "string", "n_lines": "bigint", "n_dropped": "bigint"}
    return joined.mapInArrow(run, same_schema(docs.select(*names), **added))


def dedup_lines(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``drop_repeated_lines`` over the index of the documents themselves; their lines are read and keyed once."""
    index = build_index(docs, least, doc_id=doc_id, text=text)
    return _without(docs, index, _known(index, index.postings), doc_id, text)
