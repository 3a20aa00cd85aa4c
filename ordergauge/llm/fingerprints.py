"""Document fingerprints: SimHash in column expressions, and search by permuted block tables.

The terms of a text are its runs of three words. Each occurrence of a term votes, with its 64-bit hash, for or against
every bit, so a term weighs as often as it occurs; a bit is set if more than half of the votes are for it. Votes are
counted eight bits of a long at a time: 127 hashes fit eight counters of one byte in a signed long.

For the search the 64 bits are cut into blocks. Two fingerprints that differ in ``radius`` bits at most agree in all
blocks but ``radius`` of them, so one table for each choice of agreeing blocks, keyed by the bits of these blocks,
brings every such pair together. A pair is taken from the first table that has it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, ascii_lower, checkpointed, whole_text
from .mixing import let

TERM = 3
#: hashes whose votes fit one byte for each bit, the sign bit of the last one left free
SLICE = 127
LANES = 0x0101010101010101


def _terms(text: Column) -> Column:
    """Hashes of all runs of three words, or of all words together if there are fewer; none without words."""

    def runs(words: Column) -> Column:
        return F.when(
            F.size(words) >= TERM,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - TERM),
                lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(TERM))),
            ),
        ).otherwise(F.filter(F.array(F.xxhash64(words)), lambda _: F.size(words) > 0))

    words = F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(NOT_SPACE), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _lanes(hashes: Column) -> Column:
    """Eight longs; byte ``l`` of long ``p`` counts the hashes that have bit 8 l + p set."""


    def lane(p: int) -> Column:
        add = lambda n, h: n + F.shiftrightunsigned(h, p).bitwiseAND(F.lit(LANES))
        return F.aggregate(hashes, F.lit(0).cast("long"), add)

    return F.array(*map(lane, range(8)))


def simhash(text: Column) -> Column:
    """The fingerprint of a text as a long; 0 for null and for texts without words. Equal texts have equal ones."""

    def votes(terms: Column) -> Column:
        # by index, for a slice of an array costs as much as the whole array
        last = F.size(terms) - 1
        slices = F.transform(
            F.sequence(F.lit(0), last, F.lit(SLICE)),
            lambda at: let(
                F.transform(F.sequence(at, F.least(at + (SLICE - 1), last)), lambda i: F.get(terms, i)), _lanes
            ),
        )
        slices = F.when(last >= 0, slices).otherwise(F.array().cast("array<array<bigint>>"))
        n = F.size(terms)

        def bits(counts: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.lit(63)),
                F.lit(0).cast("long"),
                lambda found, b: let(
                    F.aggregate(
                        counts,
                        F.lit(0).cast("long"),
                        lambda total, lanes: total
                        + F.call_function(
                            "shiftrightunsigned", F.get(lanes, b % 8), (b - b % 8)
                        ).bitwiseAND(F.lit(255)),
                    ),
                    lambda total: F.when(
                        2 * total > n, found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
                    ).otherwise(found),
                ),
            )

        return let(slices, bits)

    return let(_terms(text), votes)


def likeness(a: Column, b: Column) -> Column:
    """Part of the 64 bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def table_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks, the mask of their bits, as a signed long."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << j) - (1 << i) for i, j in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(stored: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, fingerprint) of distinct fingerprints at ``radius`` or fewer differing bits.

    Both inputs have a long column ``fingerprint`` without repeats; nulls match nothing. All pairs are found.
    """
    masks = table_masks(radius, blocks)
    literal = F.array(*(F.lit(m) for m in masks))

    def tables(frame: DataFrame, name: str) -> DataFrame:
        dealt = frame.select(F.col("fingerprint").alias(name), F.posexplode(literal).alias(f"{name}_table", "mask"))
        return dealt.withColumn(f"{name}_key", F.col(name).bitwiseAND(F.col("mask"))).drop("mask")

    difference = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.lit(-1)
    for number in range(len(masks) - 1, -1, -1):
        first = F.when(difference.bitwiseAND(F.lit(masks[number])) == 0, number).otherwise(first)
    return (
        tables(queries, "query")
        .join(
            tables(stored, "fingerprint"),
            (F.col("query_table") == F.col("fingerprint_table"))
            & (F.col("query_key") == F.col("fingerprint_key"))
            & (F.bit_count(difference) <= radius)
            & (first == F.col("query_table")),
        )
        .select("query", "fingerprint")
    )


def with_next(docs: DataFrame, buckets: int | None = None, **made: Column) -> DataFrame:
    """(doc_id, text) and the columns ``made``, with ``next``, their struct of the next row by descending doc_id.

    The first row follows the last. Rows of one id go by text, also descending; null ids come last. The rows are dealt
    to ranges of ids, and a copy of the first row of the next range closes each, so that no range is larger than a part
    of the table and the texts are shuffled once. The bounds of the ranges are quantiles: at most ``buckets`` numbers.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10 * buckets)).first()[0]
    known = F.array(*(F.lit(b) for b in sorted(set(bounds or [])))).cast("array<bigint>")
    bucket = F.size(F.filter(known, lambda b: b <= F.col("doc_id")))
    row = F.struct("text", *(column.alias(name) for name, column in made.items()))

    # the first row of each range: its id from a scan of the ids, its text from a join with these few ids
    tops = docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top"))
    at = F.broadcast(tops)
    heads = docs.join(at, (bucket == at["bucket"]) & F.col("doc_id").eqNullSafe(at["top"]))
    heads = heads.groupBy("bucket").agg(F.max(row).alias("row"))
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    closing = heads.select(
        F.coalesce(above, F.min("bucket").over(Window.partitionBy())).alias("bucket"),
        F.lit(None).cast("bigint").alias("doc_id"),
        "row",
        F.lit(True).alias("closing"),
    )
    rows = docs.select(bucket.alias("bucket"), "doc_id", row.alias("row"), F.lit(False).alias("closing"))
    inside = Window.partitionBy("bucket").orderBy(
        "closing", F.col("doc_id").desc_nulls_last(), F.col("row").desc_nulls_last()
    )
    followed = rows.unionByName(closing).withColumn("next", F.lead("row").over(inside))
    return followed.where("not closing").select("doc_id", "row.*", "next")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (in code points, rounded down) replaced by the beginning of another text."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and what they are like.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within): fingerprints as
    16 hex digits; ``near_next`` is the likeness to the next document by descending id, the first following the last.
    ``n_within`` counts the rows, the document itself included, within ``radius`` bits, for ids divisible by 50 (others:
    null). Null texts count as empty; a text without words has fingerprint 0. Rows of equal id go by text; rows equal in
    both give equal results but for the neighbour at the end of their run. Columns other than id and text are not looked
    at; an empty table gives an empty one, and a single document is its own next.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(F.col(text)).alias("text"))
    rows = with_next(slim, own=simhash(F.col("text")))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    found = checkpointed(
        rows.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "own",
            simhash(F.col("edited")).alias("changed"),
            F.col("next.own").alias("following"),
        )
    )
    asked = F.col("doc_id") % 50 == 0
    stored = found.groupBy(F.col("own").alias("fingerprint")).agg(F.count("*").alias("n"), F.max(asked).alias("asked"))
    pairs = within_radius(stored.select("fingerprint"), stored.where("asked").select("fingerprint"), radius)
    near = pairs.join(stored.select("fingerprint", "n"), "fingerprint").groupBy("query").agg(F.sum("n").alias("near"))
    joined = found.join(near, asked & (F.col("own") == F.col("query")), "left")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digits("own").alias("fingerprint"),
        digits("changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(asked, F.col("near")).alias("n_within"),
    )
