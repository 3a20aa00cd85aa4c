"""Several trailing windows from one pass: aggregate side by side, then one output row per window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import aggregated


def per_window(
    rows: DataFrame,
    by: Sequence[str],
    days: Sequence[int],
    measures: Callable[[int], dict[str, Column]],
) -> DataFrame:
    """Aggregate ``rows`` once for all windows and return columns ``days``, ``by`` and the measures.

    ``measures(d)`` gives the named aggregates of the window of ``d`` days; all windows share one scan, one partial
    aggregation and one shuffle. Without ``by`` there is exactly one row per window, as of a plain aggregate.
    """
    names = list(measures(days[0]))
    wide = aggregated(rows, by, *[agg.alias(f"{name}_{d}") for d in days for name, agg in measures(d).items()])
    # as one text: a column object costs more driver time than the expression it stands for
    cells = [f"named_struct('days', bigint({d}), {', '.join(f"'{name}', `{name}_{d}`" for name in names)})" for d in days]
    return wide.select(*by, F.expr(f"inline(array({', '.join(cells)}))")).select("days", *by, *names)


def window_list(days: Sequence[int], inside: Callable[[int], Column]) -> Column:
    """The window lengths whose test ``inside`` a row passes, as an array to explode."""
    picks = F.array(*[F.when(inside(d), F.lit(d).cast("bigint")) for d in days])
    return F.filter(picks, lambda d: d.isNotNull())
