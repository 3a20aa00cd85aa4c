"""Hard-negative mining by the threshold algorithm over sorted lists.

Rows are dealt to blocks, anchors to slabs, and each pair of a block and a slab is one call of a task: the anchors are a
stated set of queries, so every row is looked up from, in blocks. In a block every dimension has its rows in the order of
that component. An anchor reads all lists from the end that its own component's sign names, ever deeper; a row that
turns up anywhere is scored at once, exactly, from its whole vector. What no list has shown yet scores at most the
threshold, the anchor's product with the last values read, so reading stops once the threshold lies strictly below the
kth score of each window (a window without k rows ends once the threshold lies below the window). The best of all blocks
are merged for each anchor. The first pass finds the positives, the second the negatives of all their windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

POSITIVES = 5
NEGATIVES = 3
#: a negative's score, in percent of the positive's
LEAST, MOST = 50, 95
#: rows of a block, anchors of a slab
BLOCK, SLAB = 8192, 512
#: how deep the lists are read at first; each step doubles it
DEPTH = 32
INT64 = np.iinfo(np.int64)


class Lists:
    """The sorted lists of one block: rows of equal length, of integer components."""

    def __init__(self, vectors: np.ndarray):
        # products of whole numbers are exact in doubles up to 2 to the 53
        largest = max(1, int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        self.kind = np.float64 if largest * largest * max(1, vectors.shape[1]) < 1 << 53 else object
        self.rows = vectors.astype(self.kind)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.columns = np.arange(vectors.shape[1])

    def scores(self, anchor: np.ndarray, stop: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their scores, read until ``stop(rows, scores, threshold)``, or all of them."""
        anchor = anchor.astype(self.kind)
        n = len(self.rows)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        seen = np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, self.kind)
        depth, done = min(n, DEPTH), 0
        while done < n:
            new = np.zeros(n, bool)
            new[self.order[up, done:depth].ravel()] = True
            new[self.order[down, n - depth : n - done].ravel()] = True
            if depth == n:
                new[:] = True  # an anchor of zeros reads no list
            new &= ~seen
            seen |= new
            own = np.flatnonzero(new)
            found = np.concatenate([found, own])
            scores = np.concatenate([scores, self.rows[own] @ anchor])
            last = self.rows[self.order[up, depth - 1], up] @ anchor[up]
            threshold = last + self.rows[self.order[down, n - depth], down] @ anchor[down]
            if stop(found, scores, threshold):
                break
            depth, done = min(n, 2 * depth), depth
        return found, scores


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones those of least id."""
    if len(rows) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(rows))
    order = np.lexsort((ids[rows[keep]], -scores[keep])) if scores.dtype != object else sorted(
        range(len(keep)), key=lambda i: (-scores[keep[i]], ids[rows[keep[i]]])
    )
    return keep[order][:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(column), -1)


def _plain(scores) -> list[int]:
    return [min(max(int(x), INT64.min), INT64.max) for x in scores]


def _repeats(rows: pa.Table, k: int) -> pa.Table:
    """Each row as often as it is repeated, up to k times: no list of k could show more of it."""
    times = np.minimum(rows["copies"].to_numpy(), k)
    return rows.take(pa.array(np.repeat(np.arange(len(times)), times)))


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})


def _nearest(k: int):
    """For each anchor the k highest scores among rows of its label: (anchor, id, score, own).

    The anchor is one of these rows; ``own`` says of a row that it cannot be told from the anchor by id and score.
    """

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            rows = _repeats(rows, k)
            ids, lists = rows["vec_id"].to_numpy(), Lists(_matrix(rows["vector"]))

            def full(found, scores, threshold) -> bool:
                if len(scores) < k:
                    return False
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
                return threshold < kth

            columns = [anchors[c].to_pylist() for c in ("anchor", "vec_id")]
            for anchor, vec_id, vector in zip(*columns, _matrix(anchors["vector"]), strict=True):
                found, scores = lists.scores(vector, full)
                best = _best(found, scores, ids, k)
                whole = vector.astype(lists.kind)
                own = (ids[found[best]] == vec_id) & (scores[best] == whole @ whole)
                out += zip([anchor] * len(best), ids[found[best]].tolist(), _plain(scores[best]), own.tolist(), strict=True)
        return _table(out, anchor=pa.int64(), id=pa.int64(), score=pa.int64(), own=pa.bool_())

    return run


def window_of(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The lowest and highest score s with least * positive <= 100 * s <= most * positive; none fits if low > high."""
    return -(-least * positive // 100), most * positive // 100


def _negatives(k: int, least: int, most: int):
    """For each anchor and positive the k highest scores of other labels in the window: (anchor, place, id, score)."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            rows = _repeats(rows, k)
            ids, labels, lists = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), Lists(_matrix(rows["vector"]))
            columns = [anchors[c].to_pylist() for c in ("anchor", "label", "scores")]
            for anchor, label, positives, vector in zip(*columns, _matrix(anchors["vector"]), strict=True):
                windows = [(at, *window_of(s, least, most)) for at, s in enumerate(positives)]
                windows = [(at, low, high) for at, low, high in windows if low <= high]
                if not windows:
                    continue
                lowest = min(low for _, low, _ in windows)

                def within(found, scores, label=label, lowest=lowest):
                    near = np.flatnonzero((scores >= lowest) & (labels[found] != label))
                    return near[np.argsort(-scores[near], kind="stable")]

                def full(found, scores, threshold, within=within, windows=windows) -> bool:
                    own = scores[within(found, scores)]
                    for _, low, high in windows:
                        first = len(own) - np.searchsorted(own[::-1], high, "right")
                        kth = own[first + k - 1] if first + k <= len(own) else low
                        if not threshold < max(kth, low):
                            return False
                    return True

                found, scores = lists.scores(vector, full)
                near = within(found, scores)
                found, scores = found[near], scores[near]
                for at, low, high in windows:
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    best = inside[_best(found[inside], scores[inside], ids, k)]
                    out += zip([anchor] * len(best), [at] * len(best), ids[found[best]].tolist(), _plain(scores[best]), strict=True)
        return _table(out, anchor=pa.int64(), place=pa.int64(), id=pa.int64(), score=pa.int64())

    return run


def _cells(
    rows: DataFrame, anchors: DataFrame, keys: list[str], blocks: int, slabs: int, run, kind: str
) -> DataFrame:
    """``run`` over each pair of a block of rows and a slab of anchors that agree in ``keys``.

    Rows are repeated for each slab and anchors for each block: what a call sees is bounded by ``BLOCK`` and ``SLAB``.
    """

    def dealt(frame: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        # all under new names, for a cogroup mixes up columns that both sides have from the same frame
        frame = frame.select(*(F.col(c).alias(c) for c in frame.columns))
        whole = F.xxhash64("vec_id", "label", "vector")
        frame = frame.withColumn(own, F.pmod(whole, F.lit(parts)).cast("int"))
        return frame.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(rows, "block", blocks, "slab", slabs)
    right = dealt(anchors, "slab", slabs, "block", blocks)
    cell = [*keys, "block", "slab"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, kind)


def _parts(rows: DataFrame, keys: list[str], size: int) -> int:
    """Into how many parts the largest group of rows goes, so that one has about ``size``."""
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return -(-(most or 1) // size)


def _usable(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vector, copies, dims): integer vectors, equal rows as one."""
    values = F.col(embedding)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(values, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("bigint"))
    named = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & values.isNotNull() & finite
    found = rows.where(named).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), whole.alias("vector")
    )
    return found.groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies"), F.size("vector").alias("dims"))


def mine(
    rows: DataFrame,
    is_anchor: Column | None = None,
    relabelled: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the vectors, each component x as floor(256 x); higher ones come first, ties by
    smaller id. The positives of an anchor are its first ``positives`` other rows of the same label; the negatives of an
    anchor and a positive the first ``negatives`` rows of other labels that score ``least`` to ``most`` percent of the
    positive's score (none if that is negative). Fewer rows give fewer. ``is_anchor`` (of vec_id; default: divisible by
    50) says which rows are anchors, ``relabelled`` (of vec_id and label) gives labels to use instead.

    Rows without id, label or vector, or with a null or non-finite component, take no part; vectors of another length
    than the anchor's are no candidates for it. Repeated rows are rows of their own, as anchors, positives and
    negatives; an anchor is not its own positive. Scores beyond 64 bits stop at their limits. Other columns are not
    looked at, and an empty table gives an empty one.
    """
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    usable = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    if relabelled is not None:
        usable = usable.withColumn("label", F.when(F.col("label").isNotNull(), relabelled))
    usable = checkpointed(_usable(usable, "vec_id", "embedding", "label"))
    anchors = checkpointed(usable.where(is_anchor).select("*", F.monotonically_increasing_id().alias("anchor")))

    keys = ["dims", "label"]
    sizes = _parts(usable, keys, BLOCK), _parts(anchors, keys, SLAB)
    slim = anchors.select(*keys, "vec_id", "vector", "anchor")
    near = _cells(usable, slim, keys, *sizes, _nearest(positives + 1), "anchor bigint, id bigint, score bigint, own boolean")
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives + 1)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "own"))).alias("near"))
    # the anchor itself is one of them, unless so many others score higher
    itself = F.get(F.filter("near", lambda x: x["own"]), F.lit(0))["place"]
    others = F.filter("near", lambda x: x["place"] != F.coalesce(itself, F.lit(-1)))
    found = anchors.join(near, "anchor").withColumn("others", F.slice(others, 1, positives))
    found = checkpointed(found.select("anchor", "vec_id", "label", "vector", "dims", "copies", "others"))

    asked = found.select("dims", "vec_id", "label", "vector", "anchor", F.col("others.score").alias("scores"))
    sizes = _parts(usable, ["dims"], BLOCK), _parts(anchors, ["dims"], SLAB)
    kind = "anchor bigint, place bigint, id bigint, score bigint"
    far = _cells(usable, asked, ["dims"], *sizes, _negatives(negatives, least, most), kind)
    by_window = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    pairs = found.select("anchor", "vec_id", "copies", F.posexplode("others").alias("at", "positive"))
    joined = pairs.withColumn("place", F.col("at").cast("bigint")).join(far, ["anchor", "place"])
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return every.select(
        F.col("vec_id").alias("anchor_id"),
        F.col("positive.id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
