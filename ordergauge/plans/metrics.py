"""All metric values of the scorecard as rows (metric_id, value, label)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import AsOf, ago
from ..operators import aging, bounces, cancels, fill, payments, pickup, promises, release, returns, tickets
from ..session import shuffles_removed, work_folder
from ..sources.tables import Tables
from .shared import stored_facts


@dataclass(frozen=True)
class ReportSettings:
    """What a report depends on besides the tables. Payments and tickets may have a clock of their own."""

    as_of: AsOf
    fiscal_start: date | str
    return_account: str
    ticket_project: str
    payment_as_of: AsOf | None = None
    ticket_as_of: AsOf | None = None


def _values(frame: DataFrame, *cells: tuple[str, str] | tuple[str, str, str]) -> DataFrame:
    """Turn each row of ``frame`` into one row per cell: id, value and perhaps label, as SQL expressions.

    They are texts, analysed in one go: a column object for each of them costs the driver more time than the plan.
    """
    rows = [
        f"named_struct('metric_id', {name}, 'value', double({value}), 'label', string({label[0] if label else 'null'}))"
        for name, value, *label in cells
    ]
    return frame.selectExpr(f"inline(array({', '.join(rows)}))")


def _count(detail: DataFrame, metric_id: str) -> DataFrame:
    return _values(detail.agg(F.count("*").alias("n")), (f"'{metric_id}'", "n"))


def _pickup(t: Tables, s: ReportSettings) -> DataFrame:
    rows = pickup.bopis_processing_time(t, s.as_of, [1, 7])
    return _values(rows, ("concat('bopis_minutes_', days, 'd')", "n97_minutes"))


def _cancel_rates(t: Tables, s: ReportSettings) -> DataFrame:
    rates = cancels.cancel_rate(t, s.as_of, cancels.MAX_RATE_DAYS)
    whole = F.round(F.col("cancelled_lines") / F.nullif(F.col("created_lines"), F.lit(0)) * F.lit(100.0), 0)
    one_row = rates.agg(
        *[F.max(F.when(F.col("days") == d, F.col("cancel_rate"))).alias(f"rate_{d}") for d in (1, 7)],
        F.max(whole).alias("highest"),
    )
    return _values(
        one_row, ("'cancel_rate_1d'", "rate_1"), ("'cancel_rate_7d'", "rate_7"), ("'max_cancel_rate'", "highest")
    )


def _cancel_share(t: Tables, s: ReportSettings) -> DataFrame:
    rows = cancels.fulfilment_cancel_share(t, s.as_of, [1, 365])
    return _values(rows, ("concat('fulfilment_cancel_share_', days, 'd')", "share_pct"))


def _pickup_cancels(t: Tables, s: ReportSettings) -> DataFrame:
    return _values(cancels.bopis_cancel_rate(t, s.as_of), ("'bopis_cancel_rate_7d'", "bopis_cancel_rate"))


def _open_tickets(t: Tables, s: ReportSettings) -> DataFrame:
    return _values(tickets.open_critical_tickets(t, s.ticket_project), ("'open_critical_tickets'", "tickets"))


def _new_tickets(t: Tables, s: ReportSettings) -> DataFrame:
    rows = tickets.critical_tickets_created(t, s.ticket_as_of or s.as_of, s.ticket_project)
    return _values(rows, ("'critical_tickets_created'", "tickets"))


def _funnel(t: Tables, s: ReportSettings) -> DataFrame:
    rows = release.allocation_funnel(t, s.as_of)
    return _values(rows, ("'backordered_pct'", "backordered_pct"), ("'released_pct'", "success_pct"))


def _stuck(t: Tables, s: ReportSettings) -> DataFrame:
    return _count(release.stuck_in_allocated(t, s.as_of), "stuck_in_allocated")


def _time_to_release(t: Tables, s: ReportSettings) -> DataFrame:
    rows = release.time_to_release(t, s.as_of)
    return _values(rows, ("concat('time_to_release:', org_id)", "n97_minutes"))


def _store_success(t: Tables, s: ReportSettings) -> DataFrame:
    rows = fill.ship_from_store_success_rate(t, fill.success_periods(s.as_of, s.fiscal_start))
    return _values(rows, ("concat('ship_from_store:', period)", "success_rate_pct"))


def _promises(t: Tables, s: ReportSettings) -> DataFrame:
    rows = promises.promise_success_rate(t, s.as_of, [3, 7, 30])
    return _values(rows, ("concat('promise_success_', days, 'd')", "success_pct"))


def _fill_rates(t: Tables, s: ReportSettings) -> DataFrame:
    sums = fill.fill_rate_gap(t, s.as_of, [1, 7], fill.SUB_TYPES)
    where = "days, 'd:', location_sub_type_id"
    return _values(
        sums,
        (f"concat('fill_rate_', {where})", "fill_rate_pct"),
        (f"concat('unique_fill_rate_', {where})", "unique_fill_rate_pct"),
        (f"concat('fill_rate_gap_', {where})", "gap"),
    )


def _first_picks(t: Tables, s: ReportSettings) -> DataFrame:
    rows = fill.first_pick_fill_rate(t, s.as_of, [1, 7])
    return _values(rows, ("concat('first_pick_', days, 'd:', location_sub_type_id)", "first_pick_rate"))


def _payments(t: Tables, s: ReportSettings) -> DataFrame:
    rows = payments.payment_failure_rate_max(t, s.payment_as_of or s.as_of, [1, 7, 30])
    return _values(rows, ("concat('payment_failure_', days, 'd')", "failure_rate", "card_type"))


def _return_rates(t: Tables, s: ReportSettings) -> DataFrame:
    rows = returns.return_rate(t, s.as_of, [60, 365])
    return _values(rows, ("concat('return_rate_', days, 'd')", "return_rate_pct"))


def _blind_returns(t: Tables, s: ReportSettings) -> DataFrame:
    rows = returns.blind_return_rate(t, s.as_of, [1, 7], s.return_account)
    side = "if(marketplace, 'marketplace', 'other')"
    return _values(rows, (f"concat('blind_returns_', days, 'd:', {side})", "blind_return_pct"))


def _open_and_waiting(t: Tables, s: ReportSettings) -> DataFrame:
    rows = aging.open_and_waiting_rates(t, s.as_of)
    return _values(rows, ("concat(measure, coalesce(concat(':', location_sub_type_id), ''))", "value"))


def _to_shelf(t: Tables, s: ReportSettings) -> DataFrame:
    return _count(aging.return_to_shelf(t, s.as_of), "return_to_shelf_3d")


def _stale_picks(t: Tables, s: ReportSettings) -> DataFrame:
    return _count(aging.stale_pick_status(t, s.as_of), "stale_pick_status")


def _store_bounces(t: Tables, s: ReportSettings) -> DataFrame:
    return _values(bounces.store_bounce_rate(t, s.as_of), ("'store_bounce_rate_1d'", "bounce_rate"))


def _vendor_bounces(t: Tables, s: ReportSettings) -> DataFrame:
    return _values(bounces.vendor_bounce_rate(t, s.as_of), ("'vendor_bounce_rate_1d'", "bounce_rate"))


def _bounced(t: Tables, s: ReportSettings) -> DataFrame:
    return _count(bounces.bounced_orders(t), "bounced_orders")


def _location_bounced(t: Tables, s: ReportSettings) -> DataFrame:
    return _count(bounces.location_bounced_orders(t), "location_bounced_orders")


def _vendor_bounced(t: Tables, s: ReportSettings) -> DataFrame:
    return _values(bounces.vendor_bounced_orders(t), ("'vendor_bounced_orders'", "orders"))


FAMILIES: tuple[Callable[[Tables, ReportSettings], DataFrame], ...] = (
    _pickup,
    _cancel_rates,
    _cancel_share,
    _pickup_cancels,
    _open_tickets,
    _new_tickets,
    _funnel,
    _stuck,
    _time_to_release,
    _store_success,
    _promises,
    _fill_rates,
    _first_picks,
    _payments,
    _return_rates,
    _blind_returns,
    _open_and_waiting,
    _to_shelf,
    _stale_picks,
    _store_bounces,
    _vendor_bounces,
    _bounced,
    _location_bounced,
    _vendor_bounced,
)


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames, joined in halves: each union is analysed anew, so a chain of them costs its square."""
    if len(frames) == 1:
        return frames[0]
    half = len(frames) // 2
    return _union(frames[:half]).unionByName(_union(frames[half:]))


def history_start(settings: ReportSettings) -> datetime:
    """The earliest time that a window of the report on orders or lines begins."""
    start = settings.fiscal_start
    fiscal = date.fromisoformat(start) if isinstance(start, str) else start
    days = max(*cancels.MAX_RATE_DAYS, aging.HORIZON_DAYS)
    return min(ago(settings.as_of, days=days), datetime.combine(fiscal, time()))


def metric_values(tables: Tables, settings: ReportSettings) -> DataFrame:
    """Every metric value of the report, as one lazy plan. Each family answers all its windows from one plan.

    Most families read the same joins. ``plans.shared.stored_facts`` stores these first, as a step of its own.
    """
    return _union([family(tables, settings) for family in FAMILIES])


def stored_values(spark: SparkSession, tables: Tables, settings: ReportSettings, folder: str | None = None) -> DataFrame:
    """The rows of ``metric_values``, worked out one family after the other over the stored joins, and read back.

    As one plan all families hold their shuffle files until the last one ends, many times the input. Here those of a
    family go with it, and the disk holds the stored joins and the shuffles of one step at a time.
    """
    folder = folder or work_folder(spark)
    paths = [f"{folder}/{number:02d}{family.__name__}" for number, family in enumerate(FAMILIES)]
    with shuffles_removed(spark), stored_facts(spark, tables, history_start(settings), grain=None) as stored:
        for family, path in zip(FAMILIES, paths, strict=True):
            family(stored, settings).write.parquet(path)
    return spark.read.schema("metric_id string, value double, label string").parquet(*paths)
