"""Points in time, trailing windows and elapsed time.

``as_of`` is always a parameter. It and everything derived from it enter a plan as literals, so that filters on stored
timestamps reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | str
Days = int | Sequence[int]


def moment(as_of: AsOf) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def ts(value: datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ', timespec='microseconds')}'")


def ago(as_of: AsOf, days: int = 0, hours: int = 0) -> datetime:
    return moment(as_of) - timedelta(days=days, hours=hours)


def morning_of(as_of: AsOf) -> datetime:
    """02:00 on the day of ``as_of``, the anchor of the promise-date windows."""
    return datetime.combine(moment(as_of).date(), time(2))


def day_of(as_of: AsOf) -> date:
    return moment(as_of).date()


def windows_of(days: Days) -> list[int]:
    """One window length or several, as an ascending list."""
    return [days] if isinstance(days, int) else sorted(set(days))


# How a table can be laid out by a timestamp: suffix of the partition column, and the first day of a date's partition.
GRAINS = {"date": lambda day: day, "month": lambda day: day.replace(day=1)}


def partition_column(column: str, grain: str) -> str:
    """Name of the partition column that goes with a timestamp column (see sources.layout)."""
    return f"{column}_{grain}"


def partition_columns(df: DataFrame, column: str) -> dict[str, str]:
    """The partition columns that ``df`` has for ``column``, by grain."""
    return {grain: partition_column(column, grain) for grain in GRAINS if partition_column(column, grain) in df.columns}


def join_keys(left: DataFrame, right: DataFrame, *keys: str) -> list[str]:
    """``keys``, and the partition columns of the order's creation if both sides have them.

    They agree wherever the order does, so they change no result; with them a window on one side prunes the other.
    """
    shared = partition_columns(left, "order_created").keys() & partition_columns(right, "order_created").keys()
    return [*keys, *(partition_column("order_created", grain) for grain in sorted(shared))]


#: column metadata: from when on the rows of a stored join are whole, as far as windows on this column go
HELD_FROM = "held_from"


def held_from(df: DataFrame, start: datetime, *columns: str) -> DataFrame:
    """``df`` with the note that its history begins at ``start`` for windows on these columns."""
    for column in columns:
        df = df.withMetadata(column, {HELD_FROM: start.isoformat()})
    return df


def _check_history(df: DataFrame, column: str, start: datetime) -> None:
    held = df.schema[column].metadata.get(HELD_FROM)
    if held and start < datetime.fromisoformat(held):
        raise ValueError(f"the stored rows begin at {held}, a window on {column} from {start.isoformat()} needs more")


def since(df: DataFrame, column: str, start: datetime, inclusive: bool = True) -> DataFrame:
    """Rows with ``column`` at or after ``start`` (strictly after it if not ``inclusive``), without an upper end.

    If ``df`` is laid out by date of that column, the added test on the date lets whole partitions be skipped. Of a stored
    join that holds less history than that, a window is refused.
    """
    _check_history(df, column, start)
    stamp = F.col(column)
    keep = stamp >= ts(start) if inclusive else stamp > ts(start)
    for grain, name in partition_columns(df, column).items():
        keep &= F.col(name) >= F.lit(GRAINS[grain](start.date()))
    return df.filter(keep)


def until(df: DataFrame, column: str, end: datetime, inclusive: bool = True) -> DataFrame:
    """Rows with ``column`` at or before ``end`` (strictly before it if not ``inclusive``)."""
    stamp = F.col(column)
    keep = stamp <= ts(end) if inclusive else stamp < ts(end)
    for grain, name in partition_columns(df, column).items():
        keep &= F.col(name) <= F.lit(GRAINS[grain](end.date()))
    return df.filter(keep)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours, cut towards zero: 1 h 59 m 59 s is 1 and -3.5 h is -3."""
    return F.timestamp_diff("HOUR", start, end)
