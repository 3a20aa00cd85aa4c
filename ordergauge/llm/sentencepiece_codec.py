"""SentencePiece encoding and decoding, with giant documents encoded in parallel.

The best segmentation of a text is a best path through the lattice of its pieces. A giant document is split into
chunks. At a boundary the state of a path is the piece that holds the last character before it; that piece may reach
into the next chunk. A chunk's transfer matrix has, in max-plus algebra, the best weight from each state at its start to
each state at its end; products of such matrices are associative, so a document's best states at all boundaries come
from a scan over small matrices, and each chunk then encodes its own stretch of text on its own.

A unigram model's weights are its piece scores. A BPE model has a lattice as well: a sequence of pieces is the one that
merging gives just if each two neighbours, merged alone, stay the two (an allowed step weighs 0, any other minus
infinity). So both kinds give the segmentation of the SentencePiece library itself.

Where no piece can span a place (in front of a word's space mark, around characters outside all pieces), all paths pass
through that place, and only the stretches from a boundary to the next such place need matrices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, same_schema, small, with_arrays

MARK = "▁"
CHUNK = 1 << 15

State = tuple[int, int]


class Codec:
    """A SentencePiece model with its lattice."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # normalizer_spec { add_dummy_prefix: false }: a field given again overrides the one before
        self.inside = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        self.merges = _model_type(model) == 2
        n = self.library.get_piece_size()
        special = [self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) for i in range(n)]
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, special, strict=True)) if not s}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # a character that no longer piece holds stands alone; a mark after another character begins a piece
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.marks_begin = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.unknown = min(self.scores.values()) - 10
        self.compatible = lru_cache(1 << 18)(self._compatible)
        texts = [self._bytes(i, p) for i, p in enumerate(names)]
        self.texts = pa.array(texts, pa.binary())

    def _bytes(self, number: int, name: str) -> bytes:
        if self.library.is_byte(number):
            return bytes([int(name[3:-1], 16)])
        if self.library.is_control(number):
            return b""
        return " ⁇ ".encode() if self.library.is_unknown(number) else name.replace(MARK, " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)

    # the lattice, over the text with a mark in front and marks for spaces

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK)

    def cut(self, text: str, at: int) -> bool:
        """Whether every path has a piece end just before ``at``."""
        before, after = text[at - 1], text[at]
        if before not in self.joined or after not in self.joined:
            return True
        return self.marks_begin and after == MARK and before != MARK

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            scores = [self.scores.get(a + b) for a, b in itertools.pairwise(parts)]
            at = max((i for i, s in enumerate(scores) if s is not None), key=lambda i: (scores[i], -i), default=None)
            if at is None:
                return parts
            parts[at : at + 2] = ["".join(parts[at : at + 2])]

    def _compatible(self, left: str, right: str) -> bool:
        return self._merged(left + right) == [left, right]

    def _weight(self, left: str | None, right: str) -> float:
        if not self.merges:
            return self.scores.get(right, self.unknown)
        return 0.0 if left is None or self.compatible(left, right) else -np.inf

    def starts(self, text: str, end: int, low: int) -> list[int]:
        """Where the pieces that end at ``end`` may start, not before ``low``."""
        found = [s for s in range(max(low, end - self.longest), end) if text[s:end] in self.ids]
        return found if end - 1 in found or end <= low else [*found, end - 1]

    def across(self, text: str, at: int) -> list[State]:
        """The states at a boundary: the pieces that hold the character before it."""
        ends = range(at, min(len(text), at + self.longest - 1) + 1)
        return [(s, e) for e in ends for s in self.starts(text, e, max(0, at - self.longest)) if s < at]

    def transfer(self, text: str, low: int, high: int) -> tuple[list[State], list[State], np.ndarray]:
        """States at ``low`` and ``high`` and the matrix of best weights between them."""
        begin = [(0, 0)] if low == 0 else self.across(text, low)
        finish = self.across(text, high)
        first = next((x for x in range(low + 1, high) if self.cut(text, x)), None)
        if low and self.cut(text, low):
            first = low
        if first is None or first >= high:
            return begin, finish, self._paths(text, begin, finish, low, high)
        last = next(x for x in range(high, first - 1, -1) if x < len(text) and self.cut(text, x) or x == first)
        if last == high:  # a cut on the boundary itself: the pieces before it end there
            last = next((x for x in range(high - 1, first - 1, -1) if self.cut(text, x) or x == first), first)
        gate = [(last, last)]
        into = self._paths(text, begin, None, low, first)
        out = self._paths(text, gate, finish, last, high)
        return begin, finish, into + out

    def _paths(self, text: str, begin: list[State], finish: list[State] | None, low: int, high: int) -> np.ndarray:
        """Best weights from the states in ``begin`` to those in ``finish``, or to a cut at ``high``."""
        best: dict[int, dict[int, np.ndarray]] = {}
        for number, (s, e) in enumerate(begin):
            vector = np.full(len(begin), -np.inf)
            vector[number] = 0.0
            best.setdefault(e, {})[s] = vector
        known = set(begin)

        def reach(start: int, end: int) -> np.ndarray:
            piece, total = text[start:end], np.full(len(begin), -np.inf)
            for s, vector in best.get(start, {}).items():
                left = text[s:start] if s < start else None
                if (weight := self._weight(left, piece)) > -np.inf:
                    total = np.maximum(total, vector + weight)
            return total

        for end in range(low + 1, high + (finish is None)):
            for start in self.starts(text, end, low):
                if (start, end) not in known:
                    vector = reach(start, end)
                    if (vector > -np.inf).any():
                        best.setdefault(end, {})[start] = vector
        if finish is None:
            ends = best.get(high, {})
            if (high, high) in known or not ends:
                return np.zeros((len(begin), 1)) if high == low else np.full((len(begin), 1), -np.inf)
            return np.max(list(ends.values()), axis=0)[:, None]
        columns = []
        for s, e in finish:
            through = best.get(e, {}).get(s) if (s, e) in known else None
            columns.append(through if through is not None else reach(s, e))
        return np.stack(columns, axis=1)

    def ids_between(self, text: str, begin: State, finish: State) -> list[int]:
        """The ids of the best path from the end of one piece to the end of another."""
        (_, low), (high, end) = begin, finish
        # the library drops nothing here: its own space mark stands for a space
        inner = self.inside.encode(text[low:high]) if low < high else []
        return inner + (self.inside.encode(text[high:end]) if high >= low and high < end else [])

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """Texts of the id lists: pieces joined, the space in front taken off; broken UTF-8 gives U+FFFD."""
        flat = ids.flatten()
        lists = pa.ListArray.from_arrays(_offsets(ids), self.texts.take(flat))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.binary()))
        try:
            texts = joined.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.as_py().decode(errors="replace") for x in joined], pa.string())
        texts = pc.replace_substring_regex(texts, r"\A ", "")
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)


def _offsets(lists: pa.ListArray) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _model_type(model: bytes) -> int:
    """trainer_spec.model_type of the serialized model: 1 unigram (also if absent), 2 BPE."""
    kind = 1

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
                yield tag >> 3, data[at : at + size]
                at += size

    for number, value in fields(model):
        if number == 2:
            kind = next((x for n, x in fields(value) if n == 3), kind)
    return kind


@lru_cache(2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def best_states(chunks: list[tuple[list[State], list[State], np.ndarray]]) -> list[State]:
    """The best path's state at each boundary, from the chunks' matrices in order.

    The prefix products run left to right over one document's small matrices; then the best states follow from the end.
    """
    rows = list(itertools.accumulate((m for _, _, m in chunks), lambda a, b: (a[:, :, None] + b[None]).max(axis=1)))
    at = max(range(len(chunks[-1][1])), key=lambda j: (rows[-1][0, j], -j))
    states = [chunks[-1][1][at]]
    for k in range(len(chunks) - 1, 0, -1):
        at = int(np.argmax(rows[k - 1][0] + chunks[k][2][:, at]))
        states.append(chunks[k - 1][1][at])
    return states[::-1]


def _encode_short(docs: DataFrame, model, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in small(batches, text):
            values = [x or "" for x in batch.column(text).to_pylist()]
            found = codec.library.encode(values, num_threads=1) if values else []
            yield with_arrays(batch, ids=pa.array(found, pa.list_(pa.int32())))

    return docs.mapInArrow(run, same_schema(docs, ids="array<int>"))


def _encode_giant(docs: DataFrame, model, text: str, chunk: int) -> DataFrame:
    """Encode by chunks: cut, matrices, states by scan, and the ids of each chunk."""
    docs = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))
    reach = _codec(model.value).longest

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marked = Codec.marked(value)
                n = len(marked)
                rows = [
                    (row, k, low, min(low + chunk, n), max(0, low - reach), marked[max(0, low - reach) : low + chunk + reach])
                    for k, low in enumerate(range(0, n, chunk))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows, strict=True)], ["row", "k", "low", "high", "origin", "part"]
                )

    kinds = "row bigint, k bigint, low bigint, high bigint, origin bigint, part string"
    # read twice below, but cut from rows that are stored, so not stored once more
    chunks = docs.select("__row", text).mapInArrow(split, kinds).repartition("row", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in small(batches, "part"):
            out = []
            for x in batch.to_pylist():
                o = x["origin"]
                begin, finish, matrix = codec.transfer(x["part"], x["low"] - o, x["high"] - o)
                move = lambda states, by=o: [[s + by, e + by] for s, e in states]
                out.append((x["row"], x["k"], move(begin), move(finish), matrix.reshape(-1).tolist()))
            pairs = pa.list_(pa.list_(pa.int64()))
            kinds = [pa.int64(), pa.int64(), pairs, pairs, pa.list_(pa.float64())]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "k", "begin", "finish", "matrix"]
            )

    moves = "row bigint, k bigint, begin array<array<bigint>>, finish array<array<bigint>>, matrix array<double>"

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["k"])
        chunks = [
            (x["begin"], x["finish"], np.array(x["matrix"]).reshape(len(x["begin"]), len(x["finish"]))) for x in rows
        ]
        ends = [tuple(s) for s in best_states(chunks)]
        begins = [(0, 0), *ends[:-1]]
        return pa.table(
            {
                "row": [x["row"] for x in rows],
                "k": [x["k"] for x in rows],
                "from_end": [b[1] for b in begins],
                "to_start": [e[0] for e in ends],
                "to_end": [e[1] for e in ends],
            }
        )

    states = chunks.select("row", "k", "low", "high", "origin", "part").mapInArrow(matrices, moves)
    states = states.groupBy("row").applyInArrow(
        scan, "row bigint, k bigint, from_end bigint, to_start bigint, to_end bigint"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in small(batches, "part"):
            found = []
            for x in batch.to_pylist():
                o = x["origin"]
                begin, finish = (0, x["from_end"] - o), (x["to_start"] - o, x["to_end"] - o)
                found.append(codec.ids_between(x["part"], begin, finish))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), pa.array(found, pa.list_(pa.int32()))], ["row", "k", "own"]
            )

    own = chunks.join(states, ["row", "k"]).mapInArrow(encode, "row bigint, k bigint, own array<int>")
    whole = own.groupBy(F.col("row").alias("__row")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: x["own"])).alias("ids")
    )
    return docs.drop("ids").join(whole, "__row").drop("__row")


def encode(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The documents with ``ids``, the array of piece numbers of the whole text.

    ``model`` is the path of a model file on the driver, which is sent to the executors. Null and empty texts have an
    empty array; rows of equal id or text get equal results; extra columns pass through, one named ``ids`` is replaced;
    an empty table stays empty. Texts of over ``chunk`` code points go by chunks, the others in one piece.
    """
    with open(model, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    if chunk <= _codec(data.value).longest:
        raise ValueError("a chunk must be longer than a piece")
    long = F.coalesce(F.length(text) >= chunk, F.lit(False))
    docs = docs.drop("ids")
    short = _encode_short(docs.where(~long), data, text)
    return short.unionByName(_encode_giant(docs.where(long), data, text, chunk))


def decode(frame: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with the text of each id list. Null lists give null, empty ones the empty text.

    Decoding gives back the encoded text, save that U+2581, which the model writes for a space, comes out as a space.
    """
    with open(model, "rb") as file:
        data = frame.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value)
        for batch in small(batches, ids):
            yield with_arrays(batch, **{into: codec.decode_batch(batch.column(ids))})

    return frame.mapInArrow(run, same_schema(frame, **{into: "string"}))
