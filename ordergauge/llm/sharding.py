"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; the rank over the source's size is a fraction, which
spreads every source evenly over (0, 1). Sorting all rows by it interleaves the sources, and any stretch of that order
has their mixture, so equal cuts give shards that match it. A source begins at a seeded offset, so that small sources
do not all meet in the same shards.

No rank needs its rows in one task: rows are counted by (source, leading bits of the hash), running totals over those
few counts give offsets, and only the rows of one such bucket are numbered together. The same goes for the order by
fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60
#: buckets whose running totals are taken together
STRETCH = 1024


def _hash(*values: Column) -> Column:
    """The first 60 bits of the MD5 of the values, joined by colons; nulls as the empty text."""
    text = F.concat_ws(":", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _offsets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, rows of the keys in earlier buckets, rows of the keys).

    The running totals go in two steps, over stretches of ``STRETCH`` buckets and then inside of each, so that no task
    has a row for every bucket.
    """
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    counts = counts.withColumn("stretch", F.expr(f"`{bucket}` div {STRETCH}"))
    whole = Window.partitionBy(*keys)
    earlier = Window.unboundedPreceding, -1
    sums = counts.groupBy(*keys, "stretch").agg(F.sum("n").alias("stretch_n"))
    sums = sums.select(
        *keys,
        "stretch",
        F.coalesce(F.sum("stretch_n").over(whole.orderBy("stretch").rowsBetween(*earlier)), F.lit(0)).alias("begin"),
        F.sum("stretch_n").over(whole).alias("total"),
    )
    inside = F.sum("n").over(Window.partitionBy(*keys, "stretch").orderBy(bucket).rowsBetween(*earlier))
    return counts.join(sums, [*keys, "stretch"]).select(
        *keys, bucket, (F.col("begin") + F.coalesce(inside, F.lit(0))).alias("before"), "total"
    )


def interleaved_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 17,
    rows_together: int = 500,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot.

    Shards differ by one row at most; in each shard a source has its share of rows, up to the rounding of its stretch.
    ``size`` is the bytes of the text and 16 more. Rows are one by one, repeated ones too: identical rows share a hash
    and stand next to each other in the order. A null source is a source of its own; a null id or text hashes like the
    empty text. The result depends on the rows and the seed only. ``rows_together`` is how many rows a bucket has on
    average; buckets follow the number of rows. An empty table gives an empty one; with fewer rows than shards some
    shards stay empty.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    bits = min(40, max(10, (docs.count() // rows_together).bit_length()))
    rows = rows.select(
        "*",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("stratum"),
        _hash(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("hash"),
    ).withColumn("bucket", F.shiftright("hash", HASH_BITS - bits))

    strata = ["no_source", "stratum"]
    offsets = _offsets(rows, strata, "bucket")
    inside = Window.partitionBy(*strata, "bucket").orderBy("hash", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, [*strata, "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank") - 1)
    begin = _hash(F.lit(seed), F.lit("source"), F.col("no_source"), F.col("stratum")) / F.lit(float(1 << HASH_BITS))
    ranked = ranked.withColumn("fraction", (F.col("rank") + begin) / F.col("total"))
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * (1 << bits + 1))).drop("before", "total", "bucket")

    places = _offsets(ranked.withColumn("all", F.lit(0)), ["all"], "part")
    places = places.select("part", "before", "total")
    together = Window.partitionBy("part").orderBy("fraction", *strata, "rank")
    placed = ranked.withColumn("place", F.row_number().over(together)).join(places, "part")
    placed = placed.withColumn("place", F.col("before") + F.col("place") - 1)
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot")
    )
