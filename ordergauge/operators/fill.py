"""Fill rates of release lines."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import floor2, floor_percent, ratio
from ..functions.texts import aggregated, distinct_rows, plain_texts, same_text
from ..functions.times import AsOf, Days, ago, day_of, join_keys, since, ts, until, windows_of
from ..functions.windows import per_window
from ..sources.tables import Tables, renamed

# Location sub-types in report order.
SUB_TYPES = ("3PL", "DropShipVendor", "OwnedWM", "StoreRegular")
STORE = "StoreRegular"
VENDOR = "DropShipVendor"


def _fill_share(fulfilled: str, cancelled: str) -> Column:
    return ratio(F.col(fulfilled), F.col(fulfilled) + F.col(cancelled))


def _recent_release_lines(tables: Tables, as_of: AsOf, windows: list[int]) -> DataFrame:
    rows = tables.release_facts.filter("at_inv_location").withColumnRenamed("sub_type", "location_sub_type_id")
    return since(rows, "release_line_created", ago(as_of, days=windows[-1]), inclusive=False)


def _newer(as_of: AsOf, days: int, column: str = "release_line_created") -> Column:
    return F.col(column) > ts(ago(as_of, days=days))


@plain_texts
def fill_rate(tables: Tables, as_of: AsOf, days: Days = 1) -> DataFrame:
    """Fulfilled share of the quantities of recent release lines, per location sub-type.

    Lines are summed per release before the join with releases, so a release with very many lines is one row there.
    """
    windows = windows_of(days)
    measures = ("fulfilled_quantity", "cancelled_quantity")
    per_release = (
        since(tables["ord_release_line"], "created_timestamp", ago(as_of, days=windows[-1]), inclusive=False)
        .groupBy(*join_keys(tables["ord_release_line"], tables["ord_release"], "release_pk"))
        .agg(
            *[
                F.sum(F.when(_newer(as_of, d, "created_timestamp"), F.col(name))).alias(f"{name}_{d}")
                for d in windows
                for name in measures
            ]
        )
    )
    places = renamed(tables["ord_release"], {"pk": "release_pk", "ship_from_location_id": "location_id"}).join(
        tables["inv_location"].select("location_id", "location_sub_type_id"), "location_id"
    )

    def sums(d: int) -> dict[str, Column]:
        return {name: F.sum(f"{name}_{d}") for name in measures}

    return (
        per_window(
            per_release.join(places, join_keys(per_release, places, "release_pk")),
            ["location_sub_type_id"],
            windows,
            sums,
        )
        .withColumn("fill_rate", _fill_share("fulfilled_quantity", "cancelled_quantity"))
        .filter(F.col("fill_rate").isNotNull())
        .withColumn("fill_rate_pct", floor_percent(F.col("fill_rate")))
    )


def _fill_sums(tables: Tables, as_of: AsOf, windows: list[int]) -> DataFrame:
    """Sums of all release lines and of the distinct ones, per window and sub-type, from one grouping.

    Lines that agree in order, line, item, quantities and location are one distinct line. Being recent only depends on
    the newest copy, so the grouping needs no copy per window.
    """
    copies = aggregated(
        _recent_release_lines(tables, as_of, windows),
        [
            "order_id",
            "order_line_id",
            "release_item_id",
            "fulfilled_quantity",
            "cancelled_quantity",
            "ship_from_location_id",
            "location_sub_type_id",
        ],
        *[F.count_if(_newer(as_of, d)).alias(f"copies_{d}") for d in windows],
        apart=["location_sub_type_id"],  # a location has one
    )

    def sums(d: int) -> dict[str, Column]:
        n = F.col(f"copies_{d}")
        return {
            "fulfilled_quantity": F.sum(F.when(n > 0, F.col("fulfilled_quantity"))),
            "cancelled_quantity": F.sum(F.when(n > 0, F.col("cancelled_quantity"))),
            "all_fulfilled_quantity": F.sum(F.when(n > 0, F.col("fulfilled_quantity") * n)),
            "all_cancelled_quantity": F.sum(F.when(n > 0, F.col("cancelled_quantity") * n)),
        }

    return per_window(copies, ["location_sub_type_id"], windows, sums)


@plain_texts
def unique_fill_rate(tables: Tables, as_of: AsOf, days: Days = 1) -> DataFrame:
    """As ``fill_rate``, with release lines that agree in every compared column counted once."""
    return (
        _fill_sums(tables, as_of, windows_of(days))
        .withColumn("unique_fill_rate", _fill_share("fulfilled_quantity", "cancelled_quantity"))
        .filter(F.col("unique_fill_rate").isNotNull())
        .select(
            "days",
            "location_sub_type_id",
            "fulfilled_quantity",
            "cancelled_quantity",
            "unique_fill_rate",
            floor_percent(F.col("unique_fill_rate")).alias("unique_fill_rate_pct"),
        )
    )


@plain_texts
def fill_rate_gap(tables: Tables, as_of: AsOf, days: Days = 1, sub_types: tuple[str, ...] = (STORE, VENDOR)) -> DataFrame:
    """Distance between ``fill_rate`` and ``unique_fill_rate`` in percentage points, both from one pass."""
    percent = floor_percent(_fill_share("all_fulfilled_quantity", "all_cancelled_quantity"))
    unique_percent = floor_percent(_fill_share("fulfilled_quantity", "cancelled_quantity"))
    return (
        _fill_sums(tables, as_of, windows_of(days))
        .select(
            "days",
            "location_sub_type_id",
            percent.alias("fill_rate_pct"),
            unique_percent.alias("unique_fill_rate_pct"),
        )
        .filter(F.col("fill_rate_pct").isNotNull() & same_text(F.col("location_sub_type_id"), *sub_types))
        .withColumn("gap", floor2(F.abs(F.col("fill_rate_pct") - F.col("unique_fill_rate_pct"))))
    )


@plain_texts
def first_pick_fill_rate(tables: Tables, as_of: AsOf, days: Days = 1) -> DataFrame:
    """Share of address lines that were filled without any cancelled release line; always one row per sub-type."""
    windows = windows_of(days)

    def recent(d: int) -> Column:
        return F.col("order_created") >= ts(ago(as_of, days=d))

    address_lines = since(tables.spine, "order_created", ago(as_of, days=windows[-1])).filter(
        same_text(F.col("destination_action"), "Delivery", "Merge")
        & same_text(F.col("sub_type"), *SUB_TYPES)
        & ~same_text(F.col("delivery_method_id"), "PickUpAtStore")
        & (F.col("is_return") != 1)
        & (F.col("is_even_exchange") != 1)
    )
    kind = F.coalesce(*[F.when(same_text(F.col("sub_type"), name), name) for name in SUB_TYPES])
    address_lines = address_lines.withColumn("sub_type", kind)
    per_line = aggregated(
        address_lines,
        ["sub_type", "line_pk", "order_id", "order_line_id", "item_id", "order_created"],
        F.sum("cancelled_quantity").alias("cancelled"),
        F.max(F.col("cancelled_quantity") > 0).alias("hit"),
    )
    groups = aggregated(
        per_line,
        ["sub_type", "order_id", "order_line_id", "item_id"],
        *[
            agg
            for d in windows
            for agg in (
                F.sum(F.when(recent(d), F.col("cancelled"))).alias(f"cancelled_{d}"),
                F.count_if(recent(d) & F.col("hit")).alias(f"hit_{d}"),
            )
        ],
    )
    counts = groups.groupBy().agg(
        *[
            agg
            for d in windows
            for k, name in enumerate(SUB_TYPES)
            for agg in (
                F.count_if((F.col("sub_type") == name) & (F.col(f"cancelled_{d}") == 0)).alias(f"clean_{d}_{k}"),
                F.coalesce(F.sum(F.when(F.col("sub_type") == name, F.col(f"hit_{d}"))), F.lit(0)).alias(f"hit_{d}_{k}"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(d).cast("bigint").alias("days"),
                F.lit(name).alias("location_sub_type_id"),
                F.col(f"clean_{d}_{k}").alias("filled_lines"),
                F.col(f"hit_{d}_{k}").alias("cancelled_lines"),
            )
            for d in windows
            for k, name in enumerate(SUB_TYPES)
        ]
    )
    rate = ratio(F.col("filled_lines"), F.col("filled_lines") + F.col("cancelled_lines")) * F.lit(100.0)
    return (
        counts.select(F.inline(rows))
        .withColumn("first_pick_pct", rate)
        .withColumn("first_pick_rate", floor2(F.col("first_pick_pct")))
    )


def _day_start(day: date) -> datetime:
    return datetime.combine(day, time())


def success_periods(as_of: AsOf, fiscal_start: date | str) -> dict[str, tuple[date, date]]:
    """First and last order day of the two periods of the scorecard; both end five days before ``as_of``."""
    start = date.fromisoformat(fiscal_start) if isinstance(fiscal_start, str) else fiscal_start
    today = day_of(as_of)
    end = today - timedelta(days=5)
    return {"fiscal_year": (start, end), "30_days": (today - timedelta(days=35), end)}


@plain_texts
def ship_from_store_success_rate(tables: Tables, periods: Mapping[str, tuple[date, date]]) -> DataFrame:
    """Fulfilled share of the quantities that stores were asked to ship, per named period of order days (inclusive).

    A line's attempted quantity is what was released, at most what was ordered. Lines that agree in every reported
    column count once, and each entry of the cancel history with its own quantity makes a line of its own.
    """
    first = min(start for start, _ in periods.values())
    last = max(end for _, end in periods.values())
    history = renamed(
        tables["ord_order_line_cancel_history"], {"order_line_pk": "line_pk", "cancel_quantity": "cancel_quantity"}
    )
    line_key = join_keys(history, tables.spine, "line_pk")
    cancels = history.groupBy(*line_key, "cancel_quantity").agg(F.count("*").alias("entries"))
    inside = F.filter(
        F.array(
            *[
                F.when(
                    (F.col("order_created") >= ts(_day_start(start)))
                    & (F.col("order_created") < ts(_day_start(end + timedelta(days=1)))),
                    F.lit(name),
                )
                for name, (start, end) in periods.items()
            ]
        ),
        lambda name: name.isNotNull(),
    )
    recent = until(
        since(tables.spine, "order_created", _day_start(first)),
        "order_created",
        _day_start(last + timedelta(days=1)),
        inclusive=False,
    )
    shipped = recent.filter(
        same_text(F.col("org_sub_type"), STORE)
        & same_text(F.col("destination_action"), "Delivery", "Merge")
        & F.col("line_pk").isNotNull()
        & ((F.col("return_line_count") < 1) | F.col("return_line_count").isNull())
    ).withColumn("periods", inside)
    released = aggregated(
        shipped,
        [
            *line_key,
            "org_id",
            "order_id",
            "item_id",
            "order_line_id",
            "return_line_count",
            "line_type_id",
            "line_quantity",
            "periods",
        ],
        F.sum(F.coalesce("released_quantity", F.lit(0.0))).alias("released"),
        F.sum("fulfilled_quantity").alias("fulfilled"),
        apart=["org_id", "line_type_id"],  # of the line
    )
    ordered_quantity = F.coalesce("line_quantity", F.lit(0.0)) + F.coalesce("cancel_quantity", F.lit(0.0))
    line = ["period", "org_id", "order_id", "item_id", "order_line_id", "return_line_count"]
    entries = F.coalesce("entries", F.lit(1))
    entered = aggregated(
        released.join(cancels, line_key, "left").select("*", F.explode("periods").alias("period")),
        [*line, "line_type_id", "line_quantity", "cancel_quantity"],
        F.sum(F.col("released") * entries).alias("released"),
        F.sum(F.col("fulfilled") * entries).alias("success"),
    )
    lines = distinct_rows(
        entered.select(
            *line,
            F.coalesce("line_quantity", F.lit(0.0)).alias("remaining"),
            F.coalesce("cancel_quantity", F.lit(0.0)).alias("cancelled"),
            "released",
            F.least("released", ordered_quantity).alias("attempted"),
            "success",
        )
    )
    names = list(periods)
    sums = lines.groupBy().agg(
        *[
            F.sum(F.when(F.col("period") == name, F.col(measure))).alias(f"{measure}_{i}")
            for i, name in enumerate(names)
            for measure in ("attempted", "success")
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("period"),
                F.col(f"attempted_{i}").alias("units_attempted"),
                F.col(f"success_{i}").alias("units_fulfilled"),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        sums.select(F.inline(cells))
        .withColumn("success_rate", ratio(F.col("units_fulfilled"), F.col("units_attempted")))
        .withColumn("success_rate_pct", floor_percent(F.col("success_rate")))
    )
