"""Texts without case, as the source databases compare them.

The text columns of the logical tables carry the collation ``UTF8_LCASE`` from where they are loaded (``case_blind``), so
that filters, joins, groups and distincts on them agree without further ado. Ids and status codes keep byte order, which
lets their filters reach the scan. Two things remain to be said where they matter: a group shows one spelling of its
text, always the least, and is found by hashing (``aggregated``, ``distinct_rows``); and what an operator returns are
plain strings again (``plain_texts``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

CASE_BLIND = "UTF8_LCASE"


def is_case_blind(kind: DataType) -> bool:
    return isinstance(kind, StringType) and kind.collation == CASE_BLIND


def same_text(column: Column, *texts: str) -> Column:
    """Whether the column is one of the texts, whatever the case of either; NULL for NULL."""
    lowered = [text.lower() for text in texts]
    return F.lower(column) == lowered[0] if len(lowered) == 1 else F.lower(column).isin(*lowered)


def case_blind(df: DataFrame, texts: Collection[str]) -> DataFrame:
    """``df`` with the columns named in ``texts`` compared without case."""
    found = {
        f.name: F.collate(F.col(f.name), CASE_BLIND)
        for f in df.schema.fields
        if f.name in texts and isinstance(f.dataType, StringType) and not is_case_blind(f.dataType)
    }
    return df.withColumns(found) if found else df


def plain(df: DataFrame) -> DataFrame:
    """``df`` with plain strings."""
    found = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if is_case_blind(f.dataType)}
    return df.withColumns(found) if found else df


def plain_texts(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, returning plain strings."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        return plain(operator(*args, **kwargs))

    return run


def aggregated(rows: DataFrame, by: Sequence[str], *measures: Column, apart: Collection[str] = ()) -> DataFrame:
    """``rows.groupBy(*by).agg(*measures)``, where texts that only differ in case are one group.

    The group shows the least of its spellings. Grouping by a collated column would sort all rows first; here its
    lower-case form is the key, and groups are hashed. Texts in ``apart`` are grouped by spelling, as fast as any plain
    key: for those that the other keys decide, and where all that follows adds the groups up anyway.
    """
    blind = [f.name for f in rows.select(*by).schema if is_case_blind(f.dataType)]
    if not blind:
        return rows.groupBy(*by).agg(*measures)
    binary = {name: F.col(name).cast("string") for name in blind}
    folded = {name: f"{name}__key" for name in blind if name not in apart}
    keys = [F.lower(binary[n]).alias(folded[n]) if n in folded else binary.get(n, F.col(n)).alias(n) for n in by]
    # a minimum of texts would be found by sorting all rows, too; a set of a few spellings is not
    shown = [F.array_min(F.collect_set(binary[name])).alias(name) for name in folded]
    found = rows.groupBy(*keys).agg(*shown, *measures)
    others = [name for name in found.columns if name not in by and name not in folded.values()]
    return found.select(*[F.collate(F.col(n), CASE_BLIND).alias(n) if n in binary else n for n in by], *others)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``rows.distinct()``, where rows whose texts only differ in case are equal; the least spelling of each text stays."""
    return aggregated(rows, rows.columns) if any(is_case_blind(f.dataType) for f in rows.schema) else rows.distinct()
