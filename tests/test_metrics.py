"""Hand-made rows with results worked out by hand."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ordergauge.functions.ages import AGE_BUCKETS
from ordergauge.functions.rates import floor2, floor_percent, half_up2, number_text, ratio
from ordergauge.functions.times import hours_between, ts
from ordergauge.functions.trimmed import trimmed_mean
from ordergauge.operators import aging, bounces, cancels, fill, payments, pickup, promises, release, returns
from tests.support import spark_tables

NOW = datetime(2024, 3, 10, 12)
STORE = {"location_id": 1, "location_sub_type_id": "StoreRegular"}
VENDOR = {"location_id": 2, "location_sub_type_id": "DropShipVendor"}
SECOND = timedelta(seconds=1)


def places(*extra):
    return {"inv_location": [STORE, VENDOR, *extra], "org_location": [STORE, VENDOR, *extra]}


def open_line(pk, created, **more):
    """An order with one line that a store has not picked yet."""
    order = {"pk": pk, "order_id": f"O{pk}", "org_id": "LPS", "created_timestamp": created, "is_confirmed": 1}
    line = {"pk": pk, "order_pk": pk, "order_id": f"O{pk}", "order_line_id": "1", "min_fulfillment_status_id": "2000"}
    line |= {"delivery_method_id": "PickUpAtStore", "created_timestamp": created, "org_id": "LPS", **more}
    return order, line


def release_of(pk, number=0, location=1, **more):
    head = {"pk": pk * 100 + number, "order_pk": pk, "order_id": f"O{pk}", "release_id": f"R{number}"}
    head |= {"ship_from_location_id": location, "destination_action": "Delivery", "created_timestamp": NOW}
    line = {"release_pk": pk * 100 + number, "order_line_id": "1", "release_line_id": 1, "item_id": "A"}
    line |= {"quantity": 2, "fulfilled_quantity": 0, "cancelled_quantity": 0, "created_timestamp": NOW}
    return head, line | more


def add(data, *rows):
    for name, row in zip(("ord_order", "ord_order_line", "ord_release", "ord_release_line"), rows):
        data[name].append(row)


def test_age_buckets_leave_out_their_boundaries(spark):
    data = places() | {"ord_order": [], "ord_order_line": [], "ord_release": [], "ord_release_line": []}
    edges = [1, 2, 3, 5, 7, 10, 30, 200]
    times = [NOW - timedelta(days=d) + offset for d in edges for offset in (-SECOND, 0 * SECOND, SECOND)]
    for pk, created in enumerate(times):
        add(data, *open_line(pk, created), *release_of(pk))
    row = aging.open_orders_by_age(spark_tables(spark, data), NOW).first().asDict()
    assert row == {
        "location_sub_type_id": "StoreRegular",
        "open_0_1_day": 1,
        "open_1_2_day": 2,
        "open_2_3_day": 2,
        "open_3_5_day": 2,
        "open_5_7_day": 2,
        "open_7_10_day": 2,
        "open_10_30_day": 2,
        # older than 30 days by a second, exactly 30, and exactly 200 and a second less
        "open_30_plus_day": 4,
    }
    assert len(AGE_BUCKETS) == 8


def test_an_order_counts_once_per_sub_type_however_it_was_released(spark):
    order, line = open_line(1, NOW)
    releases = [release_of(1, n, location) for n, location in enumerate([1, 1, 2])]
    data = places() | {"ord_order": [order], "ord_order_line": [line]}
    data |= {"ord_release": [h for h, _ in releases], "ord_release_line": [rl for _, rl in releases] * 2}
    rows = aging.open_orders_by_age(spark_tables(spark, data), NOW).collect()
    assert {r.location_sub_type_id: r.open_0_1_day for r in rows} == {"StoreRegular": 1, "DropShipVendor": 1}


def test_backorder_rates_read_the_buckets_of_the_report(spark):
    data = places() | {
        "fw_status_definition": [
            {"status": "1500", "description": "Back Ordered", "profile_id": "LPS"},
            {"status": "2000", "description": "Allocated", "profile_id": "LPS"},
        ],
        "ord_order": [],
        "ord_order_line": [],
        "ord_release": [],
        "ord_release_line": [],
    }
    cases = [(NOW, "1500"), (NOW, "2000"), (NOW - timedelta(days=40), "1500"), (NOW - timedelta(days=20), "2000")]
    for pk, (created, status) in enumerate(cases):
        order, line = open_line(pk, created, min_fulfillment_status_id=status)
        head, released = release_of(pk)
        add(data, order, line, head, released)
    row = aging.backorder_rates(spark_tables(spark, data), NOW).first()
    assert row.backordered_0_1_day_rate == 50.0  # one of the two open orders of the last day
    assert row.backordered_30_plus_day_rate == 50.0  # also over the orders of the last day
    assert row.allocated_0_2_day_rate == 50.0
    assert row.allocated_all_rate == 50.0
    assert (row.allocated_30_plus_day_total, row.allocated_10_30_day_total) == (0, 1)


@pytest.mark.parametrize("n", [0, 1, 33, 34, 100])
def test_trimmed_mean_keeps_the_lowest_97_percent(spark, n):
    rows = spark.createDataFrame([("a", 7000 * i, 1) for i in range(n)], "org string, value long, weight long")
    result = trimmed_mean(rows, ["org"]).collect()
    kept = math.floor(n * 0.97)
    if n == 0:
        assert result == []
    else:
        assert (result[0].n, result[0].kept_n) == (n, kept)
        assert result[0]["mean"] == (sum(7000 * i for i in range(kept)) / kept if kept else None)


def test_trimmed_mean_against_a_sorted_list(spark):
    r = random.Random(5)
    rows = []
    for org in "abcdef":
        spread = r.choice([3, 500, 20000, 900000])
        rows += [
            (org, None if r.random() < 0.05 else r.randint(-spread, spread), r.choice([1, 1, 1, 4]))
            for _ in range(r.randint(1, 300))
        ]
    frame = spark.createDataFrame(rows, "org string, value long, weight long")
    for row in trimmed_mean(frame, ["org"]).collect():
        values = sorted(
            (v for org, v, w in rows if org == row.org for _ in range(w)), key=lambda v: (v is not None, v or 0)
        )
        kept = values[: math.floor(len(values) * 0.97)]
        total = sum(v or 0 for v in kept)
        assert (row.n, row.kept_n, row.kept_sum) == (len(values), len(kept), total)
        assert row["mean"] == (total / len(kept) if kept else None)


def test_processing_time_weighs_every_pair_of_details(spark):
    order, line = open_line(1, NOW)
    order["captured_date"] = NOW - timedelta(minutes=10)
    details = [("1000", NOW), ("1000", NOW), ("3000", NOW), ("3000", NOW + timedelta(minutes=20)), ("9000", NOW)]
    data = {
        "ord_order": [order],
        "ord_order_line": [line],
        "ord_quantity_detail": [
            {"order_line_pk": 1, "org_id": "LPS", "status_id": s, "created_timestamp": at} for s, at in details
        ],
        "fw_status_definition": [
            {"status": "1000", "description": "Open", "profile_id": "LPS"},
            {"status": "3000", "description": "Released", "profile_id": "LPS"},
        ],
    }
    row = pickup.bopis_processing_time(spark_tables(spark, data), NOW, [1]).first()
    # 10, 10, 30, 30 minutes; the lowest three are kept
    assert (row.lines, row.kept_lines, row.n97_minutes) == (4, 3, 16.67)


def test_time_to_release_per_organisation_and_cumulative(spark):
    data = {"ord_order": [], "ord_order_milestone": []}
    minutes = {"ITS": [10, 20], "MP": [60, 90], "HTW": [5, 5]}
    pk = 0
    for org, waits in minutes.items():
        for wait in waits:
            pk += 1
            data["ord_order"].append({"pk": pk, "order_id": f"O{pk}", "org_id": org, "created_timestamp": NOW})
            for kind, at in (("Allocated", NOW), ("Released", NOW + timedelta(minutes=wait))):
                milestone = f"Order::Milestone::{kind}"
                row = {"order_pk": pk, "milestone_definition_id": milestone}
                data["ord_order_milestone"].append(row | {"created_timestamp": at, "updated_timestamp": at})
    tables = spark_tables(spark, data)
    single = {r.org_id: r.n97_minutes for r in release.time_to_release(tables, NOW).collect()}
    assert single == {"ITS": 10.0, "MP": 60.0}
    grown = {r.org_id: r.n97_minutes for r in release.time_to_release(tables, NOW, cumulative=True).collect()}
    assert grown == {"ITS": 10.0, "LEA": 10.0, "LPS": 10.0, "MP": 30.0, "PRO": 30.0, "PSW": 30.0}


def test_status_codes_as_text_and_as_numbers(spark):
    codes = ["18000", "3600", "3000.000", None, "odd", "1500", "2000"]
    base = {"is_confirmed": 1, "is_cancelled": 0, "order_total": 5, "created_timestamp": NOW, "updated_timestamp": NOW}
    orders = [base | {"pk": i, "order_id": f"O{i}", "max_fulfillment_status_id": c} for i, c in enumerate(codes)]
    row = release.allocation_funnel(spark_tables(spark, {"ord_order": orders}), NOW).first()
    # as text, 18000 is below 2000 and any letter is above
    assert (row.opened, row.backordered, row.allocated, row.released, row.stuck_in_allocated) == (7, 1, 4, 3, 1)
    lines = [{"pk": i, "order_pk": i, "order_line_id": "1"} for i in range(len(codes))]
    parts = [release_of(i) for i in range(len(codes))]
    data = places() | {"ord_order": orders, "ord_order_line": lines}
    data |= {"ord_release": [h for h, _ in parts], "ord_release_line": [rl for _, rl in parts]}
    # as numbers, only 18000 is 4500 or more; text that is no number is left out
    assert bounces.store_bounce_rate(spark_tables(spark, data), NOW).first().orders == 1


def test_rates_without_a_divisor_are_null(spark):
    tables = spark_tables(spark, places())
    funnel = release.allocation_funnel(tables, NOW).first()
    assert (funnel.opened, funnel.success_pct, funnel.backordered_pct) == (0, None, None)
    assert payments.payment_failure_rate_max(tables, NOW).collect() == []
    assert cancels.cancel_rate(tables, NOW, [1, 7]).select("days", "cancel_rate").collect() == [(1, None), (7, None)]
    assert cancels.max_cancel_rate(tables, NOW).first().max_cancel_rate is None
    assert fill.fill_rate(tables, NOW).collect() == []
    assert [r.first_pick_rate for r in fill.first_pick_fill_rate(tables, NOW).collect()] == [None] * 4
    assert returns.return_rate(tables, NOW, [60]).first().return_rate_pct is None
    assert bounces.store_bounce_rate(tables, NOW).first().bounce_rate is None
    assert promises.promise_success_rate(tables, NOW).collect() == []


def test_a_release_without_result_has_no_fill_rate(spark):
    head, line = release_of(1)
    tables = spark_tables(spark, places() | {"ord_release": [head], "ord_release_line": [line]})
    assert fill.fill_rate(tables, NOW).collect() == []
    assert fill.unique_fill_rate(tables, NOW).collect() == []


def test_unique_fill_rate_counts_copies_once(spark):
    parts = [release_of(1, 0, fulfilled_quantity=1, cancelled_quantity=1)] + [
        release_of(1, n, fulfilled_quantity=3, cancelled_quantity=0) for n in (1, 2, 3)
    ]
    data = places() | {"ord_release": [h for h, _ in parts], "ord_release_line": [rl for _, rl in parts]}
    row = fill.fill_rate_gap(spark_tables(spark, data), NOW).first()
    assert (row.fill_rate_pct, row.unique_fill_rate_pct, row.gap) == (90.9, 80.0, 10.9)


@pytest.mark.parametrize("releases, expected", [(10, 0), (11, 1)])
def test_bounces_at_the_default_limits(spark, releases, expected):
    order, line = open_line(1, NOW)
    spread = [{"location_id": 10 + n, "location_sub_type_id": "StoreRegular"} for n in range(releases)]

    def tables(location):
        parts = [release_of(1, n, location(n), cancelled_quantity=1) for n in range(releases)]
        return spark_tables(
            spark,
            places(*spread)
            | {
                "ord_order": [order],
                "ord_order_line": [line],
                "ord_release": [h for h, _ in parts],
                "ord_release_line": [rl for _, rl in parts],
            },
        )

    same, different = tables(lambda n: 1), tables(lambda n: 10 + n)
    assert bounces.bounced_orders(same).count() == expected
    assert bounces.bounced_orders(different).count() == expected
    assert bounces.location_bounced_orders(same).count() == 0
    assert bounces.location_bounced_orders(different).count() == expected


def test_vendor_bounces_count_the_releases_of_the_whole_order(spark):
    order, line = open_line(1, NOW)
    order["max_fulfillment_status_id"] = "3000"
    lines = [line | {"pk": n, "order_line_id": str(n)} for n in range(6)]
    parts = [release_of(1, n, 2, cancelled_quantity=1, order_line_id=str(n)) for n in range(6)]
    data = places() | {"ord_order": [order], "ord_order_line": lines}
    data |= {"ord_release": [h for h, _ in parts], "ord_release_line": [rl for _, rl in parts]}
    assert bounces.vendor_bounced_orders(spark_tables(spark, data)).first().orders == 1
    assert bounces.vendor_bounced_orders(spark_tables(spark, data), 6).first().orders == 0


def test_id_patterns(spark):
    ids = ["CIT1", "cit1", "SLE1", "1sle1", "1SHT", "1SHT1", "O1", "xSPRx"]
    base = {"org_id": "LPS", "created_timestamp": NOW - timedelta(hours=2), "is_confirmed": 1, "is_cancelled": 0}
    base |= {"order_total": 1, "is_on_hold": False, "max_fulfillment_status_id": "2000", "payment_status_id": "1"}
    base |= {"do_not_release_before": NOW - timedelta(days=1), "return_line_count": 1, "created_by": "x"}
    data = {
        "ord_order": [base | {"pk": i, "order_id": order_id} for i, order_id in enumerate(ids)],
        "ord_payment_status": [{"status_id": "1", "short_description": "Paid"}],
    }
    tables = spark_tables(spark, data)
    stuck = {r.order_id for r in release.stuck_in_allocated(tables, NOW).collect()}
    assert stuck == set(ids) - {"CIT1"}
    returned = returns.blind_returns(tables, NOW, 1, "x").first()
    assert returned.total_returns == 4  # CIT1, cit1, 1SHT1 and O1


@pytest.mark.parametrize(
    "org, minutes, listed",
    [("MP", 31, False), ("MP", 60, True), ("LPS", 89, False), ("LPS", 91, True), ("XX", 600, False)],
)
def test_stuck_order_limits(spark, org, minutes, listed):
    order = {"pk": 1, "order_id": "O1", "org_id": org, "created_timestamp": NOW - timedelta(minutes=minutes)}
    order |= {"is_confirmed": 1, "is_cancelled": 0, "order_total": 1, "is_on_hold": False, "payment_status_id": "1"}
    order |= {"do_not_release_before": NOW - SECOND, "max_fulfillment_status_id": "2000.0"}
    data = {"ord_order": [order], "ord_payment_status": [{"status_id": "1"}]}
    assert (release.stuck_in_allocated(spark_tables(spark, data), NOW).count() == 1) is listed


def test_store_success_compares_destinations_without_case(spark):
    data = places() | {"ord_order": [], "ord_order_line": [], "ord_release": [], "ord_release_line": []}
    for pk, action in enumerate(["Delivery", "DELIVERY", "merge", "Pickup"]):
        order, line = open_line(pk, NOW - timedelta(days=10), quantity=1)
        head, released = release_of(pk, quantity=2, fulfilled_quantity=1)
        head["destination_action"] = action
        add(data, order, line, head, released)
    # three entries of equal quantity make the released quantities of line 0 count three times, at most 1 + 4
    data["ord_order_line_cancel_history"] = [{"order_line_pk": 0, "cancel_quantity": 4}] * 3
    rows = fill.ship_from_store_success_rate(
        spark_tables(spark, data), fill.success_periods(NOW, "2024-03-05")
    ).collect()
    by_period = {r.period: (r.units_attempted, r.units_fulfilled) for r in rows}
    assert by_period == {"fiscal_year": (None, None), "30_days": (5.0 + 1.0 + 1.0, 3.0 + 1.0 + 1.0)}


def test_hours_are_cut_towards_zero(spark):
    offsets = [-12600, -3599, 0, 3599, 7199, 7200]
    rows = [(i, NOW + timedelta(seconds=s)) for i, s in enumerate(offsets)]
    frame = spark.createDataFrame(rows, "i int, at timestamp_ntz")
    hours = [r.h for r in frame.select("i", hours_between(ts(NOW), F.col("at")).alias("h")).orderBy("i").collect()]
    assert hours == [-3, 0, 0, 0, 1, 2]


def promise_line(pk, promise, **more):
    order, line = open_line(pk, NOW - timedelta(days=1), is_return=0, ext_promise_release_s_l_a=promise, **more)
    return order | {"selling_channel_id": "Web"}, line


def test_release_promises(spark):
    released = NOW - timedelta(hours=5)
    cases = {
        1: (NOW + SECOND, None),  # no release yet, still time
        2: (NOW - SECOND, None),  # no release, too late
        3: (NOW, None),  # exactly now is neither
        4: (released, released + timedelta(seconds=7199)),
        5: (released, released + timedelta(seconds=7200)),
        6: (None, released),  # no promise
    }
    data = {"ord_order": [], "ord_order_line": [], "ord_release": [], "ord_release_line": []}
    for pk, (promise, at) in cases.items():
        order, line = promise_line(pk, promise)
        data["ord_order"].append(order)
        data["ord_order_line"].append(line)
        if at:
            head, part = release_of(pk)
            data["ord_release"].append(head | {"created_timestamp": at})
            data["ord_release_line"].append(part)
    # a release without creation time that holds nothing of its order's line
    order, line = promise_line(7, NOW + SECOND)
    data["ord_order"].append(order)
    data["ord_order_line"].append(line)
    data["ord_release"].append(release_of(7)[0] | {"created_timestamp": None})
    data["fw_status_definition"] = [{"status": "2000", "description": "Allocated", "profile_id": "LPS"}]
    rows = promises.promise_released(spark_tables(spark, data), NOW).collect()
    assert {r.sla_compliance: r.total for r in rows} == {
        "Awaiting Release - TBD": 2,
        "Awaiting Release - Failed SLA": 1,
        "Yes": 1,
        "No": 2,
    }
    rate = promises.promise_success_rate(spark_tables(spark, data), NOW).first()
    assert (rate.in_compliance, rate.not_in_compliance, rate.success_pct) == (1, 3, 25.0)


def test_cancel_share_chain_compares_twice(spark):
    order, line = open_line(1, NOW, updated_timestamp=NOW, max_fulfillment_status_id="9000")
    lines = [line | {"pk": n, "order_line_id": str(n)} for n in range(4)]
    parts = [release_of(1, n, cancelled_quantity=1, order_line_id=str(n)) for n in (1, 2)]
    data = places() | {"ord_order": [order], "ord_order_line": lines}
    data |= {"ord_release": [h for h, _ in parts], "ord_release_line": [rl for _, rl in parts]}
    tables = spark_tables(spark, data)
    assert cancels.fulfilment_cancel_share(tables, NOW).first().fulfilment_lines == 2  # lines 1 and 2
    assert cancels.fulfilment_cancel_share(tables, NOW, chain=True).first().fulfilment_lines == 1  # line 1 only
    data["ord_release_line"] = [parts[0][1] | {"order_line_id": "0"}, parts[1][1]]
    tables = spark_tables(spark, data)
    # a release line 0 matches every other line of the order
    assert cancels.fulfilment_cancel_share(tables, NOW, chain=True).first().fulfilment_lines == 3


def test_rounding_helpers_against_plain_numbers(spark):
    r = random.Random(3)
    values = [r.uniform(-200, 200) for _ in range(500)] + [0.0, 0.57, -0.005, 1.005, 99.995]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    x = F.col("v")
    for row in frame.select("v", floor2(x).alias("a"), floor_percent(x).alias("b"), half_up2(x).alias("c")).collect():
        assert row.a == math.floor(row.v * 100.0) / 100.0
        assert row.b == math.floor(row.v * 10000.0) / 100.0
        assert row.c == math.floor(row.v * 100.0 + 0.5) / 100.0
    texts = spark.createDataFrame([(v,) for v in (97.0, 98.5, 0.55, 0.0, 100.0, 12345678.25, None)], "v double")
    assert [t.t for t in texts.select(number_text(x).alias("t")).collect()] == [
        "97", "98.5", "0.55", "0", "100", "12345678.25", None,
    ]
    assert texts.select(ratio(x, F.lit(0)).alias("r")).distinct().collect() == [(None,)]
