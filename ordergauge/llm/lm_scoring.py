"""Language-model scores by a hashed maximum-entropy model over n-gram and skip features.

The model predicts one outcome after the other: the ``FREQUENT`` most frequent words of training have one each, all other
words share ``REST`` by hash. The softmax is factored by class: first the class of the outcome, then the outcome in it.
Logits are sums of weight rows, one for each feature of the context: the previous word, the previous two together, the
one before the previous alone. A row for the inner softmax belongs to a feature and a class; features without a row of
their own are hashed to one. The weights start at zero over the logarithms of the training frequencies, so the untrained
model is the unigram one. Within an outcome a word has its share of the training counts, and one count is for words that
training has not seen.

Texts become numbers once: slices of documents are numbered by the slice's own words, the words of all slices are counted
and joined with their counts, and each slice is cogrouped with what its words came to. No list of words leaves a slice
or the shuffle but that of the frequent ones. Training goes in rounds over disjoint parts of the documents: tasks make
gradient steps on their part from the same weights, their changes are added up in a tree of bounded groups, each row
weighed by how often the task used it, and the sum, which is as large as the model, makes the next weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, remove_folder, small

#: no word has white space in it
END = b"\n"
OUTCOMES, IN_CLASS = 1024, 32
CLASSES = OUTCOMES // IN_CLASS
FREQUENT = 768
REST = OUTCOMES - FREQUENT
#: stands before a text
START = OUTCOMES
#: weight rows of hashed word pairs, and of hashed pairs of feature and class
PAIRS, INNER = 4096, 8192
OUTER = 2 * (OUTCOMES + 1) + PAIRS
#: weight rows in one message of a training task, messages that are added up at once
BLOCK, FAN = 256, 64
BLOCKS = -(-(OUTER + INNER) // BLOCK)
ROUNDS = 2
#: tokens of one gradient step
STEP = 1 << 14
RATE = 1.0
#: text bytes and documents of a slice
SLICE, SLICE_ROWS = 16 << 20, 20_000


class Numbers(dict):
    """Words to numbers, in the order in which they turn up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, all lowest bytes first, then the next: that compresses well."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, place, doc_id, held_out, tokens) of documents, rows (slice, number, word, count) of their words."""
    base, at = TaskContext.get().partitionId() << 32, 0
    numbers, counts, size, rows = Numbers(), np.zeros(0, np.int64), 0, 0

    def made(n: int, **columns) -> pa.RecordBatch:
        arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, base + at)), *arrays[1:]], schema=schema)

    def words() -> pa.RecordBatch:
        n = len(numbers)
        own = np.arange(n, dtype=np.int32)
        return made(n, number=pa.array(own), word=pa.array(list(numbers), pa.binary()), count=pa.array(counts))

    schema = None
    for batch in batches:
        schema = schema or pa.schema([
            ("slice", pa.int64()), ("place", pa.int32()), ("doc_id", batch.schema.field("doc_id").type), ("held_out", pa.bool_()),
            ("tokens", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("count", pa.int64()),
        ])
        for part in small([batch], "text"):
            found, held = [], part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words_of = (text or b"").lower().split()
                words_of.append(END)
                found.append(np.fromiter(map(numbers.__getitem__, words_of), np.uint32, len(words_of)))
                size += len(text or b"")
            training = [x for x, out in zip(found, held, strict=True) if not out]
            more = np.bincount(np.concatenate(training), minlength=len(numbers)) if training else np.zeros(len(numbers), np.int64)
            more[: len(counts)] += counts
            counts = more
            tokens = pa.array([packed(x, 4) for x in found], pa.binary())
            place = pa.array(np.arange(rows, rows + len(found), dtype=np.int32))
            yield made(len(found), place=place, doc_id=part.column("doc_id"), held_out=part.column("held_out"), tokens=tokens)
            rows += len(found)
            if size >= SLICE or rows >= SLICE_ROWS:
                yield words()
                at, numbers, counts, size, rows = at + 1, Numbers(), np.zeros(0, np.int64), 0, 0
    if numbers:
        yield words()


def _known(documents: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a slice with what their words came to: n_tokens, n_known, known_log, outcomes."""
    n = words.num_rows
    order = words["number"].to_numpy()
    count, outcome = np.zeros(n, np.int64), np.zeros(n, np.uint16)
    count[order], outcome[order] = words["c"].to_numpy(), words["outcome"].to_numpy()
    logs = np.log10(count + 1.0)
    documents = documents.sort_by("place")
    rows = []
    for data in documents["tokens"].to_pylist():
        own = unpacked(data, 4)
        rows.append((len(own), int((count[own] > 0).sum()), float(logs[own].sum()), packed(outcome[own], 2)))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "known_log": pa.float64(), "outcomes": pa.binary()}
    table = documents.select(["doc_id", "held_out"])
    for (name, kind), values in zip(kinds.items(), columns, strict=True):
        table = table.append_column(name, pa.array(values, kind))
    return table


def _mixed(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """A weight row for two numbers, by hash."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(rows)).astype(np.uint16)


def outer_rows(last: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The weight rows of the class, by the previous outcome and the one before it."""
    own = OUTCOMES + 1
    return [last.astype(np.uint16), before.astype(np.uint16) + np.uint16(own), _mixed(last, before, PAIRS) + np.uint16(2 * own)]


def inner_rows(last: np.ndarray, before: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """The weight rows of the outcomes in a class."""
    return [_mixed(last, kind, INNER), _mixed(before + np.uint32(OUTCOMES + 1), kind, INNER)]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


@dataclass
class Model:
    """Weights (rows of ``OUTER`` and ``INNER``), the logarithms they start from, and log10 of each outcome's room."""

    outer: np.ndarray
    inner: np.ndarray
    class_log: np.ndarray
    inner_log: np.ndarray
    room_log: np.ndarray

    @classmethod
    def untrained(cls, tokens: np.ndarray, words: np.ndarray) -> Model:
        """From the training tokens and the different training words of each outcome."""
        share = (tokens + 1.0) / (tokens.sum() + OUTCOMES)
        of_class = share.reshape(CLASSES, IN_CLASS).sum(axis=1)
        inner = np.log(share.reshape(CLASSES, IN_CLASS) / of_class[:, None])
        # words that training has not seen are in the shared outcomes only
        room = np.maximum(tokens + words + (np.arange(OUTCOMES) >= FREQUENT), 1.0)
        zeros = [np.zeros((n, IN_CLASS), np.float32) for n in (OUTER, INNER)]
        return cls(*zeros, np.log(of_class).astype(np.float32), inner.astype(np.float32), np.log10(room))

    def chances(self, last, before, kind) -> tuple[np.ndarray, np.ndarray]:
        """Of each class, and of each outcome in the class ``kind``."""
        logits = self.class_log + sum(self.outer.take(r, axis=0) for r in outer_rows(last, before))
        inside = self.inner_log.take(kind, axis=0)
        for rows in inner_rows(last, before, kind):
            inside += self.inner.take(rows, axis=0)
        return _softmax(logits), _softmax(inside)


def windows(outcomes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, outcome, previous, one before) of all tokens of some documents, in stretches of ``STEP``."""
    whole = np.concatenate(outcomes).astype(np.uint32)
    begins = np.cumsum([0, *map(len, outcomes[:-1])])
    for low in range(0, len(whole), STEP):
        own = whole[low : low + STEP]
        at = np.arange(low, low + len(own))
        document = np.searchsorted(begins, at, "right") - 1
        place = at - begins[document]
        last = np.where(place >= 1, whole[at - 1], START)
        yield document, own, last, np.where(place >= 2, whole[at - 2], START)


def _step(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: list[np.ndarray], slopes: np.ndarray) -> None:
    """One gradient step on the rows that a stretch of tokens uses, shorter the more a row has moved already."""
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    touched = ranked[starts]
    sums = np.add.reduceat(slopes.take(order % len(slopes), axis=0), starts, axis=0)
    squares[touched] += np.einsum("ij,ij->i", sums, sums)
    weights[touched] -= RATE * sums / np.sqrt(squares[touched])[:, None]
    used[touched] += np.diff(np.append(starts, len(ranked)))


def _trained(model: Model):
    """What a task's documents change: rows (block, part, used, change), the change weighed by the uses of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.outer.copy(), model.inner.copy(), model.class_log, model.inner_log, model.room_log)
        squares = [np.full(len(x), 1e-6, np.float32) for x in (own.outer, own.inner)]
        used = [np.zeros(len(x)) for x in (own.outer, own.inner)]
        for part in small(batches, "outcomes"):
            for _, outcome, last, before in windows([unpacked(x, 2) for x in part.column("outcomes").to_pylist()]):
                kind, place, each = outcome // IN_CLASS, outcome % IN_CLASS, np.arange(len(outcome))
                classes, inside = own.chances(last, before, kind)
                classes[each, kind] -= 1
                inside[each, place] -= 1
                _step(own.outer, squares[0], used[0], outer_rows(last, before), classes)
                _step(own.inner, squares[1], used[1], inner_rows(last, before, kind), inside)
        uses = np.zeros(BLOCKS * BLOCK)
        change = np.zeros((BLOCKS * BLOCK, IN_CLASS), np.float32)
        uses[: OUTER + INNER] = np.concatenate(used)
        change[: OUTER + INNER] = np.concatenate([own.outer - model.outer, own.inner - model.inner])
        change *= uses[:, None].astype(np.float32)
        blocks = [b for b in range(BLOCKS) if uses[b * BLOCK : (b + 1) * BLOCK].any()]
        rows = [(uses[b * BLOCK : (b + 1) * BLOCK].tobytes(), change[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in blocks]
        yield _messages(blocks, [TaskContext.get().partitionId()] * len(blocks), rows)

    return run


def _messages(blocks: list[int], parts: list[int], rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(blocks, pa.int32()), pa.array(parts, pa.int32())]
    columns += [pa.array([r[i] for r in rows], pa.binary()) for i in range(2)]
    return pa.RecordBatch.from_arrays(columns, ["block", "part", "used", "change"])


def _added(table: pa.Table) -> pa.Table:
    """The sum of some messages on one block."""
    table = table.sort_by("part")
    sums = [
        sum(np.frombuffer(x, kind).astype(np.float64) for x in table[name].to_pylist()).astype(kind).tobytes()
        for name, kind in (("used", np.float64), ("change", np.float32))
    ]
    one = _messages([table["block"][0].as_py()], [table["part"][0].as_py() // FAN], [tuple(sums)])
    return pa.Table.from_batches([one])


def _round(model: Model, texts: DataFrame) -> Model:
    """The model after one round of training on documents with ``outcomes``."""
    kind = "block int, part int, used binary, change binary"
    changes = texts.select("outcomes").mapInArrow(_trained(model), kind)
    parts = texts.rdd.getNumPartitions()
    while True:
        grouped = changes.groupBy("block", F.expr(f"part div {FAN}").alias("group"))
        changes = grouped.applyInArrow(_added, kind)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    used, change = np.zeros(BLOCKS * BLOCK), np.zeros((BLOCKS * BLOCK, IN_CLASS))
    for row in changes.collect():  # as large as the model
        at = slice(row.block * BLOCK, (row.block + 1) * BLOCK)
        used[at] = np.frombuffer(row.used)
        change[at] = np.frombuffer(row.change, np.float32).reshape(-1, IN_CLASS)
    change = (change / np.maximum(used, 1)[:, None]).astype(np.float32)
    outer, inner = model.outer + change[:OUTER], model.inner + change[OUTER : OUTER + INNER]
    return Model(outer, inner, model.class_log, model.inner_log, model.room_log)


def text_logs(model: Model, outcomes: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each document's outcomes, less the room of each: known_log completes it to the words'."""
    total = np.zeros(len(outcomes))
    for document, outcome, last, before in windows(outcomes):
        kind, place, each = outcome // IN_CLASS, outcome % IN_CLASS, np.arange(len(outcome))
        classes, inside = model.chances(last, before, kind)
        logs = np.log10(classes[each, kind].astype(np.float64)) + np.log10(inside[each, place].astype(np.float64))
        total += np.bincount(document, logs - model.room_log[outcome], len(outcomes))
    return total


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, "outcomes"):
            logs = text_logs(model, [unpacked(x, 2) for x in part.column("outcomes").to_pylist()])
            names = [n for n in part.schema.names if n != "outcomes"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(logs)], [*names, "model_log"])

    return run


def scores(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z in lower case, then one end, which null and empty texts have too.
    ``held_out`` (null: not) says which documents the model does not learn from. ``n_known`` counts the tokens that
    training has; ``train_tokens`` are all tokens of training. ``base_score`` is the sum of log10 of the smoothed shares,
    (count + 1) / (train_tokens + different training tokens + 1). ``score`` is log10 of the probability that the
    model gives the text. Nothing to learn from leaves all counts at 0 and the model without knowledge.

    Repeated rows and rows without id are documents of their own. Columns other than id and text, and those that
    ``held_out`` reads, are not looked at. An empty table gives an empty one. Reruns on the same files and settings
    agree; files laid out otherwise are learned from in another order, which changes ``score`` a little.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text")
    )
    of_id = docs.schema[doc_id].dataType.simpleString()
    sliced, counted, known = (new_folder(spark) for _ in range(3))
    kind = f"slice bigint, place int, doc_id {of_id}, held_out boolean, tokens binary, number int, word binary, count bigint"
    store = lambda frame, path: frame.write.option("compression", "zstd").parquet(path)
    store(slim.mapInArrow(_sliced, kind), sliced)
    words = spark.read.parquet(sliced).where("word is not null").select("slice", "number", "word", "count")
    store(words.groupBy("word").agg(F.sum("count").alias("c")), counted)
    counts = spark.read.parquet(counted)
    frequent = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    named = spark.createDataFrame([(r.word, i) for i, r in enumerate(frequent)], "word binary, own int")
    shared = (F.pmod(F.xxhash64("word"), F.lit(REST)) + FREQUENT).cast("int")
    placed = counts.join(F.broadcast(named), "word", "left").withColumn("outcome", F.coalesce("own", shared)).drop("own")

    tokens, different = np.zeros(OUTCOMES), np.zeros(OUTCOMES)
    for row in placed.groupBy("outcome").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("words")).collect():
        tokens[row.outcome], different[row.outcome] = row.c, row.words
    total, vocabulary = int(tokens.sum()), int(different.sum())

    # all under new names, for a cogroup mixes up columns that both sides have from the same frame
    found = words.join(placed, "word").select(F.col("slice").alias("part"), "number", "c", "outcome")
    texts = spark.read.parquet(sliced).where("tokens is not null").select("slice", "place", "doc_id", "held_out", "tokens")
    kind = f"doc_id {of_id}, held_out boolean, n_tokens bigint, n_known bigint, known_log double, outcomes binary"
    store(texts.groupBy("slice").cogroup(found.groupBy("part")).applyInArrow(_known, kind), known)
    remove_folder(spark, sliced)
    remove_folder(spark, counted)

    texts = spark.read.parquet(known)
    model = Model.untrained(tokens, different)
    for number in range(rounds if total else 0):
        own = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(rounds)) == number
        model = _round(model, texts.where(~F.col("held_out") & own))
    kind = f"doc_id {of_id}, held_out boolean, n_tokens bigint, n_known bigint, known_log double, model_log double"
    return texts.mapInArrow(_scored(model), kind).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1)))).alias("base_score"),
        (F.col("known_log") + F.col("model_log")).alias("score"),
    )
