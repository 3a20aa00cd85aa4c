"""Token counts of flat token files by a separator scan.

A token file is one run of fixed-width numbers in which a separator ends each document; nothing says where. The files
are read in blocks that know nothing of documents. Each block is searched for the separator as one array; what a block
leaves open at its end is carried to the next separator by a prefix scan over the blocks of a file, in which a block is
a few numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, small

BLOCKS = "file bigint, block bigint, tokens binary, ids array<bigint>"


def token_blocks(docs: DataFrame, separator: int, width: int = 2, block: int = 1 << 16, ids: str = "ids") -> DataFrame:
    """Flat files of the documents' tokens, one for each partition, cut into blocks of ``block`` tokens.

    (file, block, tokens, ids): ``tokens`` are little-endian numbers of ``width`` bytes, the separator after each
    document, the empty ones too; a null list counts as empty. Blocks do not end with documents. ``ids`` are the
    ``doc_id`` of the documents whose separator lies in the block. A token equal to the separator, or one that does not
    fit the width, is an error.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, held, waiting = TaskContext.get().partitionId(), 0, np.zeros(0, kind), []
        at = 0  # tokens in earlier blocks

        def out(tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal number, at, waiting
            at += len(tokens)
            own = [i for i, end in waiting if end <= at]
            waiting = [x for x in waiting if x[1] > at]
            number += 1
            row = [[file], [number - 1], [tokens.tobytes()], [own]]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(x, t) for x, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "tokens", "ids"])

        for batch in small(batches, "ids"):
            lists = batch.column("ids")
            parts = [held]
            end = at + len(held)
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), lists, strict=True):
                values = tokens.values.to_numpy() if tokens.is_valid else np.zeros(0, np.int64)
                if (values == separator).any() or (len(values) and (values.max() >> 8 * width or values.min() < 0)):
                    raise ValueError(f"document {doc} has a token that cannot be stored")
                parts += [values.astype(kind), np.array([separator], kind)]
                end += len(values) + 1
                waiting.append((doc, end))
            held = np.concatenate(parts)
            while len(held) >= block:
                yield out(held[:block])
                held = held[block:]
        if len(held):
            yield out(held)

    return docs.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, BLOCKS)


def stored(blocks: DataFrame) -> DataFrame:
    """The blocks written to a new folder under the shared one, compressed, and read back."""
    path = new_folder(blocks.sparkSession)
    blocks.write.option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS).parquet(path)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = 1 << 16) -> DataFrame:
    """Raw token files (each under 2 GB, Spark's limit for one value) as blocks; ``file`` is a hash of the path."""
    size = width * block
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    blocks = files.select(
        F.xxhash64("path").alias("file"),
        "content",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block"),
    )
    return blocks.select(
        "file",
        "block",
        F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"),
        F.lit(None).cast("array<bigint>").alias("ids"),
    )


def separator_scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """One row per document: (file, place, start, n_tokens, ended, doc_id), ``place`` counting from 0 in the file.

    ``n_tokens`` leaves the separator out, ``start`` is the offset of the first token. A document that its file breaks
    off, without a separator, comes last with ``ended`` false. ``doc_id`` is null where the blocks have no ids. Blocks of
    a file must be there once each; empty blocks, and an empty table, give no rows.
    """
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "tokens"):
            sizes, lasts, ends = [], [], []
            for tokens in batch.column("tokens"):
                values = np.frombuffer(tokens.as_buffer(), kind) if tokens.is_valid else np.zeros(0, kind)
                found = np.flatnonzero(values == separator)
                sizes.append(len(values))
                lasts.append(int(found[-1]) if len(found) else None)
                ends.append(found)
            columns = [
                batch.column("file"),
                batch.column("block"),
                pa.array(sizes, pa.int64()),
                pa.array(lasts, pa.int64()),
                pa.array(ends, pa.list_(pa.int64())),
                batch.column("ids"),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "last", "ends", "ids"])

    found = blocks.select("file", "block", "tokens", "ids").mapInArrow(
        search, "file bigint, block bigint, n bigint, last bigint, ends array<bigint>, ids array<bigint>"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"),
        F.lead("block").over(order).isNull().alias("closes"),
    )
    # where the document that is open at the block's start began
    scanned = scanned.withColumn(
        "open", F.coalesce(F.max(F.col("offset") + F.col("last") + 1).over(before), F.lit(0))
    ).withColumn("stop", F.col("offset") + F.col("n"))
    ended = F.transform(
        F.col("ends"),
        lambda end, i: F.struct(
            (F.col("earlier") + i).alias("place"),
            F.when(i == 0, F.col("open"))
            .otherwise(F.col("offset") + F.get(F.col("ends"), i - 1) + 1)
            .alias("start"),
            (F.col("offset") + end).alias("stop"),
            F.lit(True).alias("ended"),
            F.get(F.col("ids"), i).alias("doc_id"),
        ),
    )
    tail_start = F.coalesce(F.col("offset") + F.col("last") + 1, F.col("open"))
    tail = F.struct(
        (F.col("earlier") + F.size("ends")).alias("place"),
        tail_start.alias("start"),
        F.col("stop").alias("stop"),
        F.lit(False).alias("ended"),
        F.lit(None).cast("bigint").alias("doc_id"),
    )
    broken = F.col("closes") & (tail_start < F.col("stop"))
    documents = F.when(broken, F.concat(ended, F.array(tail))).otherwise(ended)
    return scanned.select("file", F.explode(documents).alias("d")).select(
        "file", "d.place", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), "d.ended", "d.doc_id"
    )
