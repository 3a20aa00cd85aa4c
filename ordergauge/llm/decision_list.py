"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics, grown condition by condition for the
gain in junk found, pruned from its end on rows set aside, and kept if it is precise enough; the rows it covers leave,
and the next rule is grown on the rest. The list comes out as one ordered Spark conditional expression, whose default
is to keep the document.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same_schema, small, with_arrays

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "new_word_share")
#: what thresholds may be set on
STATISTICS = ("n_words", *RATIOS)

_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(string.punctuation.encode(), np.uint8)


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows that stand twice or more in the text, and the number of different words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(ids) < 4:
        return 0, len(numbers)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum()), len(numbers)


def statistics_of(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and ratios of one UTF-8 text, in the order of ``COUNTS`` and ``RATIOS``."""
    words = text.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(bytes_of.sum() - bytes_of[0x80:0xC0].sum() - bytes_of[_SPACE].sum())
    symbols = int(bytes_of[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated_lines = len(lines) - len(set(lines))
    repeated, different = _repeated(words)
    n = len(words)
    ratios = [
        chars / n,
        symbols / chars,
        int(bytes_of[_MARKS].sum()) / chars,
        int(bytes_of[65:91].sum()) / chars,
        repeated_lines / len(lines),
        repeated / n,
        different / n,
    ]
    return [n, chars, symbols, repeated_lines, repeated], ratios


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the columns of ``COUNTS`` (long) and ``RATIOS`` (double) of their whole texts.

    Row by row, without a shuffle. Null and empty texts, and texts without words, have zeros. Extra columns pass
    through; columns named like a statistic are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text):
            values = batch.column(text).cast(pa.binary()).to_pylist()
            found = [statistics_of(x or b"") for x in values]
            columns = {c: pa.array([x[0][i] for x in found], pa.int64()) for i, c in enumerate(COUNTS)}
            columns |= {c: pa.array([x[1][i] for x in found], pa.float64()) for i, c in enumerate(RATIOS)}
            yield with_arrays(batch, **columns)

    return docs.mapInArrow(run, same_schema(docs, **dict.fromkeys(COUNTS, "bigint"), **dict.fromkeys(RATIOS, "double")))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        values = rows[:, STATISTICS.index(self.name)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for condition in rule:
        out &= condition.holds(rows)
    return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds between neighbouring values, at quantiles if there are many."""
    values = np.unique(values)
    if len(values) > most:
        values = np.unique(np.quantile(values, np.linspace(0, 1, most)))
    return (values[1:] + values[:-1]) / 2


def _grow(rows: np.ndarray, junk: np.ndarray, longest: int) -> Rule:
    """Conditions added while one gains, by how much surer the junk that it still covers becomes."""
    rule: Rule = ()
    while len(rule) < longest and junk.any() and not junk.all():
        base, best, chosen = np.log2(junk.mean()), 1e-9, None
        for at, name in enumerate(STATISTICS):
            cuts = _cuts(rows[:, at])
            # junk and rows at or below each cut
            below = np.searchsorted(np.sort(rows[:, at]), cuts, "right")
            junk_below = np.searchsorted(np.sort(rows[junk, at]), cuts, "right")
            for above in (False, True):
                hits = junk.sum() - junk_below if above else junk_below
                covered = len(rows) - below if above else below
                gain = hits * (np.log2(np.maximum(hits, 1e-9) / np.maximum(covered, 1)) - base)
                if len(gain) and gain.max() > best:
                    best, chosen = gain.max(), Condition(name, above, float(cuts[gain.argmax()]))
        if chosen is None:
            break
        rule = (*rule, chosen)
        keep = chosen.holds(rows)
        rows, junk = rows[keep], junk[keep]
    return rule


def _prune(rule: Rule, rows: np.ndarray, junk: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on; the shortest of equals."""

    def worth(part: Rule) -> float:
        hits = junk[_covers(part, rows)]
        return (2 * hits.mean() - 1) if len(hits) else -1.0

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=worth, default=())


def learn(
    rows: np.ndarray, junk: np.ndarray, precision: float = 0.95, least: int = 5, longest: int = 4, most: int = 24
) -> list[Rule]:
    """The ordered rules for junk: (rows by ``STATISTICS``, whether each is junk). Every third row is for pruning.

    A rule stays if ``precision`` of what it newly covers is junk, on the rows it grew on and on those set aside, and if
    it covers ``least`` junk rows. No junk, or no rows, gives no rules.
    """
    rules: list[Rule] = []
    for_pruning = np.arange(len(rows)) % 3 == 2
    while len(rules) < most and junk[~for_pruning].any():
        rule = _grow(rows[~for_pruning], junk[~for_pruning], longest)
        rule = _prune(rule, rows[for_pruning], junk[for_pruning])
        covered = _covers(rule, rows)
        parts = [junk[covered & for_pruning], junk[covered & ~for_pruning]]
        if not rule or junk[covered].sum() < least or any(len(x) and x.mean() < precision for x in parts):
            break
        rules.append(rule)
        rows, junk, for_pruning = rows[~covered], junk[~covered], for_pruning[~covered]
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    number = F.lit(None).cast("int")
    for at in range(len(rules), 0, -1):
        holds = rules[at - 1][0].column()
        for condition in rules[at - 1][1:]:
            holds = holds & condition.column()
        number = F.when(holds, F.lit(at)).otherwise(number)
    return number


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> list[Rule]:
    """The rules learned from labelled documents (``quality`` 0 is junk).

    ``sample`` bounds the labelled rows that are looked at, drawn by a seeded hash of the id; the statistics of one
    document for each, a few numbers, come to the driver. Labels without id or quality, and those of unknown documents,
    count for nothing. Of an id stored more than once the document of least statistics counts, however often it is
    stored; an id labelled more than once gives a row for each quality. Labels of junk alone, or of none, give no rules.
    """
    drawn = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").alias("__id"), "quality")
        .distinct()
        .orderBy(F.xxhash64(F.lit(7), "__id"), "__id", "quality")
        .limit(sample)
    )
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(drawn), "__id")
    found = statistics(chosen).groupBy("__id", "quality").agg(F.min(F.struct(*STATISTICS)).alias("least"))
    rows = sorted(tuple(r) for r in found.select("__id", "quality", "least.*").collect())
    if not rows:
        return []
    table = np.array(rows, dtype=np.float64)
    # neighbours in id may be copies of each other: an even draw needs another order
    table = table[np.random.default_rng(7).permutation(len(table))]
    return learn(table[:, 2:], table[:, 1] == 0)


def base_failed() -> Column:
    """Too few words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents with their statistics, ``base_failed``, ``failed_rule`` (number or null) and ``kept``.

    A document that fails the base, as null and empty texts do, is not kept whatever the rules say.
    """
    added = statistics(docs, text).withColumns({"base_failed": base_failed(), "failed_rule": rule_number(rules)})
    return added.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
