"""The registered queries once more as plain SQL for DuckDB, over the views of ``ordergauge.sources.samples``.

These texts follow the definitions row by row (joins, then filters, then one aggregate per window) and share nothing
with the Spark plans but the views and the fixed values of the scorecard.
"""

from __future__ import annotations

from ordergauge.plans.scorecard import FILLS, GOALS
from ordergauge.sources.samples import with_views

AS_OF = "2001-08-02 00:00:00"
PAYMENT_AS_OF = "2024-01-31 00:00:00"
FISCAL_START = "2000-10-01"
ACCOUNT = "blind@example.com"
PROJECT = "Order Desk"
NOW = f"TIMESTAMP '{AS_OF}'"
PAY_NOW = f"TIMESTAMP '{PAYMENT_AS_OF}'"
MORNING = f"TIMESTAMP '{AS_OF[:10]} 02:00:00'"

AGES = (
    ("open_0_1_day", None, 1),
    ("open_1_2_day", 1, 2),
    ("open_2_3_day", 2, 3),
    ("open_3_5_day", 3, 5),
    ("open_5_7_day", 5, 7),
    ("open_7_10_day", 7, 10),
    ("open_10_30_day", 10, 30),
    ("open_30_plus_day", 30, None),
)
ALL_AGES = " + ".join(name for name, _, _ in AGES)


def _windows(days: list[int]) -> str:
    return f"(select unnest({days})::bigint as days) w"


def _start(now: str = NOW) -> str:
    return f"{now} - interval 1 day * w.days"


def _div(a: str, b: str) -> str:
    return f"(({a})::double / nullif(({b})::double, 0))"


def _floor2(x: str) -> str:
    return f"(floor(({x}) * 100) / 100)"


def _pct(x: str) -> str:
    return f"(floor(({x}) * 10000) / 100)"


def _num(x: str) -> str:
    return f"try_cast({x} as double)"


def _money(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(28,6))) as double)"


def _age_test(column: str, young: int | None, old: int | None) -> str:
    if young is None:
        return f"{column} > {NOW} - interval {old} day"
    if old is None:
        return f"{column} <= {NOW} - interval {young} day"
    return f"{column} < {NOW} - interval {young} day and {column} > {NOW} - interval {old} day"


def _age_counts(column: str) -> str:
    return ", ".join(f"count(*) filter (where {_age_test(column, lo, hi)}) as {name}" for name, lo, hi in AGES)


RELEASE_JOIN = "ord_release_line rl join ord_release r on r.pk = rl.release_pk"
SPINE = f"""{RELEASE_JOIN}
    join inv_location il on il.location_id = r.ship_from_location_id
    join ord_order o on o.pk = r.order_pk
    join ord_order_line l on l.order_pk = o.pk and l.order_line_id = rl.order_line_id"""


def _trimmed(pairs: str, by: str, n: str, kept: str) -> str:
    cut = "floor(n * 0.97::double)"
    return f"""
    select {by}, max(n) as {n}, max({cut})::bigint as {kept},
      floor({_div(f"sum(v) filter (where rn <= {cut})", f"max({cut})")} / 60 * 100 + 0.5) / 100 as n97_minutes
    from (select {by}, v, count(*) over (partition by {by}) as n,
            row_number() over (partition by {by} order by v nulls first) as rn from ({pairs}))
    group by {by}"""


def _processing_pairs(days: list[int], what: str) -> str:
    details = """(select d.order_line_pk, d.created_timestamp, s.description from ord_quantity_detail d
        join fw_status_definition s on s.status = d.status_id and s.profile_id = d.org_id)"""
    return f"""
    select w.days, {what}
    from {_windows(days)}, {details} a
    join {details} b on b.order_line_pk = a.order_line_pk and lower(b.description) = 'released'
    join ord_order_line l on l.pk = a.order_line_pk and lower(l.delivery_method_id) = 'pickupatstore'
    join ord_order o on o.pk = l.order_pk
    where lower(a.description) = 'open' and a.created_timestamp >= {_start()} and o.created_timestamp >= {_start()}"""


def bopis_processing_time(days: list[int]) -> str:
    pairs = _processing_pairs(days, "epoch(b.created_timestamp) - epoch(o.captured_date) as v")
    return _trimmed(pairs, "days", "lines", "kept_lines")


def bopis_processing_lines(days: list[int]) -> str:
    minutes = "(epoch(b.created_timestamp) - epoch(o.captured_date)) / 60.0::double as minutes"
    return _processing_pairs(days, f"{minutes}, cast(l.pk as varchar) as line")


def cancel_rate(days: list[int], digits: int = 2) -> str:
    base = "ord_order_line l join ord_order o on o.pk = l.order_pk"
    good = "o.is_confirmed = 1 and o.max_return_status_id is null"
    return f"""
    select a.days, cancelled_lines, created_lines, cancelled_total, created_total,
      round({_div("cancelled_lines", "created_lines")} * 100, {digits}) as cancel_rate
    from (select w.days, count(l.pk) as cancelled_lines, {_money("l.cancelled_order_line_sub_total")} as cancelled_total
          from {_windows(days)} left join ({base}) on {good} and l.is_cancelled = 1
            and l.max_fulfillment_status_id = '9000' and l.updated_timestamp >= {_start()} group by 1) a
    join (select w.days, count(l.pk) as created_lines, {_money("l.order_line_sub_total")} as created_total
          from {_windows(days)} left join ({base}) on {good} and l.created_timestamp >= {_start()} group by 1) b
      on a.days = b.days"""


def max_cancel_rate() -> str:
    return f"select max(cancel_rate) as max_cancel_rate from ({cancel_rate([1, 7, 30, 90, 365], 0)})"


def fulfilment_cancel_share(days: list[int], chain: bool = False) -> str:
    same = "rl.order_line_id = l.order_line_id"
    if chain:
        same = f"cast(({same}) as int) = coalesce({_num('rl.order_line_id')}, 0)"
    lines = "l.max_fulfillment_status_id is not null and " + _num("l.max_fulfillment_status_id") + " = 9000"
    share = f"{_div('fulfilment_lines', 'cancelled_lines')} * 100"
    return f"""
    select *, {share} as share, {_floor2(share)} as share_pct from (
      select w.days,
        (select count(distinct l.pk) from ord_order_line l join ord_order o on o.pk = l.order_pk
           join ord_release r on r.order_pk = o.pk
           join org_location ol on ol.location_id = r.ship_from_location_id
           join ord_release_line rl on rl.release_pk = r.pk and {same}
         where l.updated_timestamp >= {_start()} and {lines} and rl.cancelled_quantity > 0
           and ol.location_sub_type_id in ('DropShipVendor', 'StoreRegular')) as fulfilment_lines,
        (select count(distinct l.pk) from ord_order_line l join ord_order o on o.pk = l.order_pk
         where l.updated_timestamp >= {_start()} and {lines} and o.is_confirmed = 1) as cancelled_lines
      from {_windows(days)})"""


PICKUP = """ful_fulfillment_line fl join ful_fulfillment f on f.pk = fl.fulfillment_pk
      and lower(f.order_type_id) <> 'marketplace' and lower(f.delivery_method_id) = 'pickupatstore'
    join org_location ol on ol.location_id = f.ship_from_location_id and ol.location_sub_type_id = 'StoreRegular'"""


def bopis_lines(days: int) -> str:
    return f"""
    select {_money("round(fl.item_unit_price * fl.ordered_qty, 2)")} as ordered_price, count(*) as pickup_lines
    from {PICKUP} where fl.created_timestamp > {NOW} - interval {days} day"""


def _short_rows(days: int) -> str:
    return f"""from {PICKUP} join ful_fulfillment_line_shorts s on s.fulfillment_line_pk = fl.pk
    where s.updated_timestamp > {NOW} - interval {days} day and fl.fulfillment_line_status_id = '9000.000'
      and f.cancel_reason_id is null"""


def bopis_shorts(days: int) -> str:
    return f"""
    select s.short_reason_id, {_money("round(fl.item_unit_price * fl.cancelled_qty, 2)")} as cancelled_price,
      count(*) as short_lines, max(t.pickup_lines) as pickup_lines,
      round({_div("count(*)", "max(t.pickup_lines)")} * 100, 2) as percent_of_total
    from ({bopis_lines(days)}) t, (select s.short_reason_id, fl.item_unit_price, fl.cancelled_qty {_short_rows(days)}) s,
      lateral (select s.item_unit_price, s.cancelled_qty) fl
    group by 1"""


def bopis_cancel_rate(days: int) -> str:
    return f"""
    select short_lines, pickup_lines, {_pct(_div("short_lines", "pickup_lines"))} as bopis_cancel_rate
    from (select count(*) as short_lines {_short_rows(days)}) a, ({bopis_lines(days)}) b"""


def allocation_funnel(hours: int) -> str:
    success = f"{_div('released', 'allocated')} * 100"
    return f"""
    select *, {success} as success_rate, {_pct(_div("backordered", "opened"))} as backordered_pct,
      {_floor2(success)} as success_pct
    from (select count(*) as opened, count(*) filter (where max_fulfillment_status_id = '1500') as backordered,
            count(*) filter (where max_fulfillment_status_id >= '2000') as allocated,
            count(*) filter (where max_fulfillment_status_id >= '3000') as released,
            count(*) filter (where max_fulfillment_status_id = '2000') as stuck_in_allocated
          from ord_order where created_timestamp > {NOW} - interval {hours} hour
            and is_confirmed = 1 and is_cancelled = 0 and order_total > 0)"""


def stuck_in_allocated(hours: int) -> str:
    return f"""
    select * from (
      select o.org_id, o.order_id, o.created_timestamp,
        cast(epoch({NOW}) - epoch(o.created_timestamp) as bigint) as aging_seconds, p.short_description
      from ord_order o join ord_payment_status p on p.status_id = o.payment_status_id
      where not o.is_on_hold and o.created_timestamp > {NOW} - interval {hours} hour
        and {_num("o.max_fulfillment_status_id")} = 2000 and o.is_confirmed = 1 and o.is_cancelled = 0
        and o.order_total > 0 and o.do_not_release_before < {NOW})
    where aging_seconds > case when org_id = 'MP' then 1800 else 5400 end
      and org_id in ('HTW', 'ITS', 'LEA', 'LPS', 'MP', 'PRO', 'PSW')
      and order_id not like 'CIT%' and aging_seconds >= 3600"""


def _release_pairs(hours: int, what: str) -> str:
    def side(kind: str, column: str) -> str:
        return f"""(select o.order_id, o.org_id, m.{column} as at from ord_order o
            join ord_order_milestone m on m.order_pk = o.pk
            where m.milestone_definition_id = 'Order::Milestone::{kind}'
              and o.created_timestamp > {NOW} - interval {hours} hour)"""

    return f"""
    select {what}
    from {side("Allocated", "created_timestamp")} a
    join {side("Released", "updated_timestamp")} b on a.order_id = b.order_id"""


def time_to_release_orders(hours: int) -> str:
    return _release_pairs(hours, "a.org_id, (epoch(b.at) - epoch(a.at))::bigint as seconds")


def time_to_release(hours: int, cumulative: bool = False) -> str:
    orgs = ["ITS", "LEA", "LPS", "MP", "PRO", "PSW"]
    target = f"unnest(list_slice({orgs}, list_position({orgs}, a.org_id), 6))" if cumulative else "a.org_id"
    pairs = _release_pairs(hours, f"{target} as org_id, epoch(b.at) - epoch(a.at) as v")
    pairs += f"\n    where list_contains({orgs}, a.org_id)"
    return _trimmed(pairs, "org_id", "orders", "kept_orders")


def payment_failure_rate(days: list[int]) -> str:
    return f"""
    select *, {_div("failed_transactions", "total_transactions")} * 100 as failure_rate
    from (select w.days, pm.card_type, pt.transaction_type,
            count(*) filter (where pt.payment_response_status = 'Failure') as failed_transactions,
            count(*) as total_transactions
          from {_windows(days)} join pay_payment_transaction pt on pt.created_timestamp >= {_start(PAY_NOW)}
          join pay_payment_method pm on pm.pk = pt.payment_method_pk
          join ord_order o on o.order_id = pt.order_id
          join ord_payment_status ps on ps.status_id = o.payment_status_id
          where pt.transaction_type = 'Authorization' and pm.card_type is not null
            and pm.payment_type not in ('AR Credit', 'Gift Card', 'PayPal')
          group by 1, 2, 3)
    where failed_transactions > 0"""


def payment_failure_rate_max(days: list[int]) -> str:
    return f"""
    select days, card_type, {_floor2("failure_rate")} as failure_rate from ({payment_failure_rate(days)})
    qualify row_number() over (partition by days order by failure_rate desc, card_type desc) = 1"""


def _fill(days: list[int], rows: str, name: str) -> str:
    share = _div("fulfilled_quantity", "fulfilled_quantity + cancelled_quantity")
    return f"""
    select *, {share} as {name}, {_pct(share)} as {name}_pct
    from (select days, location_sub_type_id, sum(fulfilled_quantity) as fulfilled_quantity,
            sum(cancelled_quantity) as cancelled_quantity from ({rows}) group by 1, 2)
    where {share} is not null"""


def _fill_rows(days: list[int], distinct: str) -> str:
    return f"""
    select {distinct} w.days, r.order_id, rl.order_line_id, rl.item_id, rl.fulfilled_quantity, rl.cancelled_quantity,
      r.ship_from_location_id, il.location_sub_type_id
    from {_windows(days)} join ord_release_line rl on rl.created_timestamp > {_start()}
    join ord_release r on r.pk = rl.release_pk join inv_location il on il.location_id = r.ship_from_location_id"""


def fill_rate(days: list[int]) -> str:
    return _fill(days, _fill_rows(days, ""), "fill_rate")


def unique_fill_rate(days: list[int]) -> str:
    return _fill(days, _fill_rows(days, "distinct"), "unique_fill_rate")


def fill_rate_gap(days: list[int]) -> str:
    return f"""
    select a.days, a.location_sub_type_id, fill_rate_pct, unique_fill_rate_pct,
      {_floor2("abs(fill_rate_pct - unique_fill_rate_pct)")} as gap
    from ({fill_rate(days)}) a join ({unique_fill_rate(days)}) b
      on a.days = b.days and a.location_sub_type_id = b.location_sub_type_id
    where a.location_sub_type_id in ('DropShipVendor', 'StoreRegular')"""


def first_pick_fill_rate(days: list[int]) -> str:
    pct = f"{_div('filled_lines', 'filled_lines + cancelled_lines')} * 100"
    base = f"""select w.days, o.order_id, l.order_line_id, l.item_id, l.pk, il.location_sub_type_id, rl.cancelled_quantity
      from {_windows(days)}, {SPINE}
      where lower(r.destination_action) in ('delivery', 'merge') and o.created_timestamp >= {_start()}
        and lower(l.delivery_method_id) <> 'pickupatstore' and l.is_return <> 1 and l.is_even_exchange <> 1"""
    return f"""
    select *, {pct} as first_pick_pct, {_floor2(pct)} as first_pick_rate from (
      select w.days, t.kind as location_sub_type_id,
        (select count(*) from (select 1 from ({base}) b where b.days = w.days and b.location_sub_type_id = t.kind
           group by order_id, order_line_id, item_id having sum(cancelled_quantity) = 0)) as filled_lines,
        (select count(distinct b.pk) from ({base}) b where b.days = w.days and b.location_sub_type_id = t.kind
           and b.cancelled_quantity > 0) as cancelled_lines
      from {_windows(days)}, (values ('3PL'), ('DropShipVendor'), ('OwnedWM'), ('StoreRegular')) as t(kind))"""


def ship_from_store_success_rate() -> str:
    ordered = "coalesce(l.quantity, 0) + coalesce(h.cancel_quantity, 0)"
    day = f"{NOW}::date"
    periods = f"""(select 'fiscal_year' as period, date '{FISCAL_START}' as first_day, {day} - 5 as last_day
        union all select '30_days', {day} - 35, {day} - 5) p"""
    share = _div("units_fulfilled", "units_attempted")
    return f"""
    select *, {share} as success_rate, {_pct(share)} as success_rate_pct from (
      select period, sum(attempted) as units_attempted, sum(success) as units_fulfilled from (
        select distinct period, org_id, order_id, item_id, order_line_id, return_line_count, remaining, cancelled,
          released, attempted, success
        from (select p.period, o.org_id, o.order_id, l.item_id, l.order_line_id, o.return_line_count, l.line_type_id,
                coalesce(l.quantity, 0) as remaining, coalesce(h.cancel_quantity, 0) as cancelled,
                sum(coalesce(rl.quantity, 0)) as released, least(sum(coalesce(rl.quantity, 0)), {ordered}) as attempted,
                sum(rl.fulfilled_quantity) as success
              from {periods} join ord_order o on o.created_timestamp::date between p.first_day and p.last_day
              join ord_order_line l on l.order_id = o.order_id
              left join ord_order_line_cancel_history h on h.order_line_pk = l.pk
              join ord_release r on r.order_id = o.order_id
              join ord_release_line rl on rl.release_pk = r.pk and rl.order_line_id = l.order_line_id
              join org_location ol on ol.location_id = r.ship_from_location_id
              where coalesce(o.return_line_count, 0) < 1 and ol.location_sub_type_id = 'StoreRegular'
                and lower(r.destination_action) in ('delivery', 'merge')
              group by p.period, o.org_id, o.order_id, l.item_id, l.order_line_id, o.return_line_count, l.line_type_id,
                l.quantity, h.cancel_quantity))
      group by period)"""


def return_rate(days: list[int]) -> str:
    rate = f"{_div('returned_orders', 'fulfilled_orders')} * 100"
    status = _num("o.max_fulfillment_status_id")
    return f"""
    select *, {rate} as return_rate, {_floor2(rate)} as return_rate_pct
    from (select w.days, count(distinct o.order_id) filter (where {status} = 8500) as returned_orders,
            count(distinct o.order_id) filter (where {status} = 7000) as fulfilled_orders
          from {_windows(days)} left join ord_order o
            on o.created_timestamp >= {_start()} and o.max_return_status_id is null group by 1)"""


def _return_rows(days: list[int]) -> str:
    parts = " ".join(f"and lower(o.order_id) not like '%{p}%'" for p in ("sit", "sle", "slp", "spr", "sps"))
    return f"""(select w.days, o.org_id, o.created_by from {_windows(days)}
      join ord_order o on o.created_timestamp >= {_start()}
      where o.return_line_count > 0 and lower(o.order_id) not like '%sht' {parts})"""


def blind_returns(days: list[int]) -> str:
    return f"""
    select *, {_div("blind_returns", "total_returns")} * 100 as blind_pct,
      {_div("expected_returns", "total_returns")} * 100 as expected_pct
    from (select days, org_id, count(*) filter (where created_by <> '{ACCOUNT}') as expected_returns,
            count(*) filter (where created_by = '{ACCOUNT}') as blind_returns, count(*) as total_returns
          from {_return_rows(days)} group by 1, 2)"""


def blind_return_rate(days: list[int]) -> str:
    return f"""
    select *, {_pct(_div("blind_returns", "total_returns"))} as blind_return_pct
    from (select days, coalesce(org_id = 'MP', false) as marketplace, count(*) filter (where created_by = '{ACCOUNT}') as blind_returns,
            count(*) as total_returns
          from {_return_rows(days)} group by 1, 2)"""


def open_orders_by_age() -> str:
    return f"""
    select location_sub_type_id, {_age_counts("created_timestamp")}
    from (select distinct o.order_id, il.location_sub_type_id, o.created_timestamp from {SPINE}
          where o.created_timestamp >= {NOW} - interval 200 day
            and rl.cancelled_quantity + rl.fulfilled_quantity <> rl.quantity
            and case when l.min_fulfillment_status_id < '3600' then
                  il.location_sub_type_id in ('3PL', 'DropShipVendor', 'OwnedWM')
                  or lower(l.delivery_method_id) = 'pickupatstore'
                  or (lower(l.delivery_method_id) = 'shiptostore' and lower(r.destination_action) = 'merge')
                  or (lower(l.delivery_method_id) = 'shiptoaddress' and il.location_sub_type_id = 'StoreRegular'
                      and l.min_fulfillment_status_id in ('3000', '3500'))
                else lower(l.delivery_method_id) = 'shiptoaddress' and il.location_sub_type_id = 'StoreRegular'
                  and l.min_fulfillment_status_id = '3600' end)
    group by 1"""


def open_order_rates() -> str:
    vendor = "filter (where location_sub_type_id = 'DropShipVendor')"
    other = "filter (where location_sub_type_id is distinct from 'DropShipVendor')"
    old = "open_30_plus_day"
    totals = {
        "open_7_30_day_rate": _pct(_div("sum(open_7_10_day + open_10_30_day)", f"sum({ALL_AGES})")),
        "non_vendor_share_of_30_plus_day": _pct(_div(f"coalesce(sum({old}) {other}, 0)", f"sum({old})")),
        "open_30_plus_day_total": f"coalesce(sum({old}), 0)",
        "vendor_open_30_plus_day_rate": _pct(_div(f"sum({old}) {vendor}", f"sum({ALL_AGES}) {vendor}")),
        "vendor_open_5_7_day_rate": _pct(_div(f"sum(open_5_7_day) {vendor}", f"sum({ALL_AGES}) {vendor}")),
        "open_0_1_day_total": "coalesce(sum(open_0_1_day), 0)",
        "open_0_2_day_total": "coalesce(sum(open_0_1_day + open_1_2_day), 0)",
        "open_total": f"coalesce(sum({ALL_AGES}), 0)",
    }
    ages = open_orders_by_age()
    parts = [
        f"""select 'open_2_3_day_rate' as measure, location_sub_type_id, {_pct(_div("open_2_3_day", ALL_AGES))}::double
        as value from ages"""
    ]
    parts += [f"select '{n}', null::varchar, ({v})::double from ages" for n, v in totals.items()]
    return f"with ages as ({ages}) " + " union all ".join(parts)


def backorder_orders_by_age() -> str:
    return f"""
    select order_status, {_age_counts("created_timestamp")}
    from (select distinct o.order_id, case lower(s.description) when 'allocated' then 'Allocated' else 'Back Ordered' end as order_status, o.created_timestamp
          from ord_order o join ord_order_line l on l.order_pk = o.pk
          join fw_status_definition s on s.status = l.min_fulfillment_status_id and s.profile_id = o.org_id
          where o.created_timestamp >= {NOW} - interval 200 day and {_num("s.status")} < 7000 and o.is_confirmed = 1
            and lower(s.description) in ('allocated', 'back ordered'))
    group by 1"""


def backorder_rates() -> str:
    def waiting(expr: str, status: str) -> str:
        return f"coalesce((select sum({expr}) from waiting where order_status = '{status}'), 0)"

    def opened(expr: str) -> str:
        return f"(select sum({expr}) from ages)"

    return f"""
    with ages as ({open_orders_by_age()}), waiting as ({backorder_orders_by_age()})
    select {_pct(_div(waiting("open_0_1_day", "Back Ordered"), opened("open_0_1_day")))} as backordered_0_1_day_rate,
      {_pct(_div(waiting("open_30_plus_day", "Back Ordered"), opened("open_0_1_day")))} as backordered_30_plus_day_rate,
      {_pct(_div(waiting("open_0_1_day + open_1_2_day", "Allocated"), opened("open_0_1_day + open_1_2_day")))}
        as allocated_0_2_day_rate,
      {_pct(_div(waiting(ALL_AGES, "Allocated"), opened(ALL_AGES)))} as allocated_all_rate,
      {waiting("open_30_plus_day", "Allocated")}::bigint as allocated_30_plus_day_total,
      {waiting("open_10_30_day", "Allocated")}::bigint as allocated_10_30_day_total"""


def return_to_shelf(days: int = 3) -> str:
    return f"""
    select ship_to_location_id, strftime(c, '%Y-%m-%d') as created_date, order_id, fulfillment_id, customer_first_name,
      customer_last_name, strftime(e, '%Y-%m-%d') as pickup_expiry_date, item_id, ordered_qty, item_unit_price,
      description, trunc((epoch({NOW}::date) - epoch(min(c))) / 86400)::bigint as age_in_days
    from (select f.ship_to_location_id, f.created_timestamp as c, fl.order_id, f.fulfillment_id, f.customer_first_name,
            f.customer_last_name, f.pickup_expiry_date as e, fl.item_id, fl.ordered_qty, fl.item_unit_price,
            s.description
          from ful_fulfillment f join ful_fulfillment_line fl on fl.fulfillment_pk = f.pk
          join ful_status_definition s on s.status = fl.fulfillment_line_status_id and s.profile_id = 'LPS'
          where f.pickup_expiry_date <= {NOW} - interval {days} day and fl.fulfillment_line_status_id = '3000.000')
    group by ship_to_location_id, c, order_id, fulfillment_id, customer_first_name, customer_last_name, e, item_id,
      ordered_qty, item_unit_price, description"""


def stale_pick_status() -> str:
    labels = {
        "open_0_1_day": "Open 0-1 day",
        "open_1_2_day": "Open 1-2 day",
        "open_2_3_day": "Open 2-3 day",
        "open_3_5_day": "Open 3-5 day",
        "open_5_7_day": "Open 5-7 day",
        "open_7_10_day": "Open 7-10 day",
        "open_10_30_day": "Open 10-30 day",
        "open_30_plus_day": "Open 30+ day",
    }
    cases = " ".join(f"when {_age_test('o.created_timestamp', lo, hi)} then '{labels[n]}'" for n, lo, hi in AGES)
    return f"""
    select o.order_id, r.release_id, l.item_id, r.ship_from_location_id, r.delivery_method_id,
      strftime(o.created_timestamp, '%Y-%m-%d') as created_date, s.description, case {cases} end as age
    from {SPINE} join fw_status_definition s on s.status = l.min_fulfillment_status_id and s.profile_id = o.org_id
    where lower(l.delivery_method_id) = 'shiptoaddress' and il.location_sub_type_id = 'StoreRegular'
      and l.min_fulfillment_status_id = '3600' and rl.fulfilled_quantity + rl.cancelled_quantity < rl.quantity"""


def _bounce_rate(kind: str, days: int, by: str, count: str, name: str) -> str:
    mean = _div("bounces", name)
    return f"""
    select *, {mean} as mean_bounces, {_floor2(mean)} as bounce_rate
    from (select count(*) as {name}, sum(n)::bigint as bounces
          from (select {count} as n from {RELEASE_JOIN}
                join inv_location il on il.location_id = r.ship_from_location_id
                join ord_order o on o.order_id = r.order_id
                where o.updated_timestamp > {NOW} - interval {days} day and il.location_sub_type_id = '{kind}'
                  and {_num("o.max_fulfillment_status_id")} >= 4500
                group by {by}))"""


def store_bounce_rate(days: int) -> str:
    hits = "count(*) filter (where rl.cancelled_quantity > 0)"
    return _bounce_rate("StoreRegular", days, "r.order_id", hits, "orders")


def vendor_bounce_rate(days: int) -> str:
    return _bounce_rate("DropShipVendor", days, "r.order_id, rl.order_line_id", "count(distinct rl.release_pk)", "lines")


BOUNCED = """ord_order o join ord_release r on r.order_id = o.order_id
    join ord_order_line l on l.order_pk = o.pk
    join inv_location il on il.location_id = r.ship_from_location_id and il.location_sub_type_id = 'StoreRegular'
    join ord_release_line rl on rl.release_pk = r.pk and rl.order_line_id = l.order_line_id
    where l.min_fulfillment_status_id not in ('1500', '3600', '7000', '7500', '8000', '8500', '9000', '18000')
      and rl.cancelled_quantity <> 0"""


def bounced_orders(minimum: int) -> str:
    return f"""
    select o.order_id, l.order_line_id, l.item_id, l.is_on_hold, l.max_fulfillment_status_id,
      l.min_fulfillment_status_id, o.created_timestamp, count(distinct r.release_id) as releases
    from {BOUNCED} group by all having releases > {minimum}"""


def location_bounced_orders(minimum: int) -> str:
    return f"""
    select o.order_id, o.created_timestamp, l.order_line_id, count(distinct r.ship_from_location_id) as locations
    from {BOUNCED} group by all having locations > {minimum}"""


def vendor_bounced_orders(minimum: int) -> str:
    return f"""
    select count(*) as orders from (
      select o.order_id from ord_order o join ord_release r on r.order_id = o.order_id
      join ord_order_line l on l.order_pk = o.pk
      join inv_location il on il.location_id = r.ship_from_location_id
      join ord_release_line rl on rl.release_pk = r.pk
      where il.location_sub_type_id = 'DropShipVendor' and {_num("o.max_fulfillment_status_id")} < 6000
        and rl.cancelled_quantity > 0
      group by o.order_id having count(distinct r.release_id) > {minimum})"""


def _hours(a: str, b: str) -> str:
    return f"trunc((epoch({b}) - epoch({a})) / 3600)"


def _promise(days: list[int], org: str, verdict: str, rows: str, column: str, where: str) -> str:
    return f"""
    select w.days, {org} as org_id, {verdict} as sla_compliance, count(*) as total
    from {_windows(days)}, {rows}
    where {column} <= {MORNING} and {column} >= {_start(MORNING)} and {where}
    group by 1, 2, 3"""


def promise_released(days: list[int]) -> str:
    late = _hours("l.ext_promise_release_s_l_a", "r.created_timestamp")
    verdict = f"""case
        when r.created_timestamp is null and l.ext_promise_release_s_l_a > {NOW} then 'Awaiting Release - TBD'
        when r.created_timestamp is null and l.ext_promise_release_s_l_a < {NOW} then 'Awaiting Release - Failed SLA'
        when {late} <= 1 then 'Yes' else 'No' end"""
    rows = """ord_order o join ord_order_line l on l.order_pk = o.pk
      join fw_status_definition s on s.status = l.min_fulfillment_status_id and s.profile_id = o.org_id
      left join ord_release r on r.order_pk = o.pk
      left join ord_release_line rl on rl.release_pk = r.pk and rl.order_line_id = l.order_line_id"""
    where = """l.is_return = 0 and o.org_id <> 'MP' and s.description <> 'Canceled'
      and o.selling_channel_id <> 'CallCenter' and (rl.release_line_id > 0 or r.created_timestamp is null)
      and l.ext_promise_release_s_l_a is not null"""
    return _promise(days, "o.org_id", verdict, rows, "o.created_timestamp", where)


def promise_shipped(days: list[int]) -> str:
    late = _hours("l.promised_ship_date", "d.fulfillment_date")
    rows = """ord_order o join ord_order_line l on l.order_pk = o.pk
      join ord_release r on r.order_pk = o.pk
      join ord_release_line rl on rl.release_pk = r.pk and rl.order_line_id = l.order_line_id
      join ord_fulfillment_detail d on d.order_line_pk = l.pk and d.release_id = r.release_id
        and d.release_line_id = rl.release_line_id"""
    where = f"""rl.fulfilled_quantity > 0 and o.org_id <> 'MP' and l.promised_ship_date is not null
      and {_num("l.max_fulfillment_status_id")} <> 9000 and l.is_return = 0 and d.status_id in ('7000', '7500')
      and o.selling_channel_id <> 'CallCenter'"""
    verdict = f"case when {late} <= 1 then 'Yes' else 'No' end"
    return _promise(days, "o.org_id", verdict, rows, "o.created_timestamp", where)


def promise_delivered(days: list[int]) -> str:
    late = _hours("l.promised_delivery_date", "t.delivered_date")
    rows = """ord_fulfillment_detail d join ord_order_line l on l.pk = d.order_line_pk
      join ord_order o on o.pk = l.order_pk
      join ord_release r on r.release_id = d.release_id and r.order_pk = l.order_pk
      join ord_release_line rl on rl.release_pk = r.pk and rl.release_line_id = d.release_line_id
      join ord_order_tracking_info t on t.tracking_number = d.tracking_number and t.order_pk = l.order_pk"""
    where = """l.org_id <> 'MP' and l.is_return = 0 and o.selling_channel_id <> 'CallCenter'
      and l.promised_delivery_date is not null and d.status_id = '7500'"""
    verdict = f"case when {late} <= 1 then 'Yes' else 'No' end"
    return _promise(days, "l.org_id", verdict, rows, "l.created_timestamp", where)


def promise_compliance(days: list[int]) -> str:
    both = " union all ".join(f"({part(days)})" for part in (promise_released, promise_shipped, promise_delivered))
    return f"""
    select days, org_id, coalesce(sum(total) filter (where sla_compliance = 'Yes'), 0)::bigint as in_compliance,
      coalesce(sum(total) filter (where sla_compliance in ('No', 'Awaiting Release - Failed SLA')), 0)::bigint
        as not_in_compliance
    from ({both}) group by 1, 2"""


def promise_success_rate(days: list[int]) -> str:
    share = _div("in_compliance", "in_compliance + not_in_compliance")
    return f"""
    select *, {_pct(share)} as success_pct
    from (select days, sum(in_compliance)::bigint as in_compliance, sum(not_in_compliance)::bigint as not_in_compliance
          from ({promise_compliance(days)}) group by 1)"""


def open_critical_tickets() -> str:
    return f"""select count(*) as tickets from tickets
    where project = '{PROJECT}' and priority = 'critical' and status_category <> 'Done'"""


def critical_tickets_created(hours: int) -> str:
    return f"""select count(*) as tickets from tickets
    where project = '{PROJECT}' and component = 'critical' and created >= {PAY_NOW} - interval {hours} hour"""


def metric_values() -> str:
    gap = f"""
    select a.days, a.location_sub_type_id, fill_rate_pct, unique_fill_rate_pct,
      {_floor2("abs(fill_rate_pct - unique_fill_rate_pct)")} as gap
    from ({fill_rate([1, 7])}) a join ({unique_fill_rate([1, 7])}) b
      on a.days = b.days and a.location_sub_type_id = b.location_sub_type_id"""
    kind = "days || 'd:' || location_sub_type_id"
    waiting = (
        "backordered_0_1_day_rate",
        "backordered_30_plus_day_rate",
        "allocated_0_2_day_rate",
        "allocated_all_rate",
        "allocated_30_plus_day_total",
        "allocated_10_30_day_total",
    )
    parts = [
        ("'bopis_minutes_' || days || 'd'", "n97_minutes", bopis_processing_time([1, 7])),
        ("'cancel_rate_' || days || 'd'", "cancel_rate", cancel_rate([1, 7])),
        ("'max_cancel_rate'", "max_cancel_rate", max_cancel_rate()),
        ("'fulfilment_cancel_share_' || days || 'd'", "share_pct", fulfilment_cancel_share([1, 365])),
        ("'bopis_cancel_rate_7d'", "bopis_cancel_rate", bopis_cancel_rate(7)),
        ("'open_critical_tickets'", "tickets", open_critical_tickets()),
        ("'critical_tickets_created'", "tickets", critical_tickets_created(24)),
        ("'backordered_pct'", "backordered_pct", allocation_funnel(24)),
        ("'released_pct'", "success_pct", allocation_funnel(24)),
        ("'stuck_in_allocated'", "n", f"select count(*) as n from ({stuck_in_allocated(24)})"),
        ("'time_to_release:' || org_id", "n97_minutes", time_to_release(24)),
        ("'ship_from_store:' || period", "success_rate_pct", _both_periods()),
        ("'promise_success_' || days || 'd'", "success_pct", promise_success_rate([3, 7, 30])),
        (f"'fill_rate_' || {kind}", "fill_rate_pct", gap),
        (f"'unique_fill_rate_' || {kind}", "unique_fill_rate_pct", gap),
        (f"'fill_rate_gap_' || {kind}", "gap", gap),
        (f"'first_pick_' || {kind}", "first_pick_rate", first_pick_fill_rate([1, 7])),
        ("'return_rate_' || days || 'd'", "return_rate_pct", return_rate([60, 365])),
        (
            "'blind_returns_' || days || 'd:' || case when marketplace then 'marketplace' else 'other' end",
            "blind_return_pct",
            blind_return_rate([1, 7]),
        ),
        ("measure || coalesce(':' || location_sub_type_id, '')", "value", open_order_rates()),
        *[(f"'{name}'", name, backorder_rates()) for name in waiting],
        ("'return_to_shelf_3d'", "n", f"select count(*) as n from ({return_to_shelf()})"),
        ("'stale_pick_status'", "n", f"select count(*) as n from ({stale_pick_status()})"),
        ("'store_bounce_rate_1d'", "bounce_rate", store_bounce_rate(1)),
        ("'vendor_bounce_rate_1d'", "bounce_rate", vendor_bounce_rate(1)),
        ("'bounced_orders'", "n", f"select count(*) as n from ({bounced_orders(10)})"),
        ("'location_bounced_orders'", "n", f"select count(*) as n from ({location_bounced_orders(10)})"),
        ("'vendor_bounced_orders'", "orders", vendor_bounced_orders(5)),
    ]
    unions = [
        f"select {name} as metric_id, ({value})::double as value, null::varchar as label from ({text})"
        for name, value, text in parts
    ]
    unions.append(
        f"""select 'payment_failure_' || days || 'd', failure_rate::double, card_type
        from ({payment_failure_rate_max([1, 7, 30])})"""
    )
    return "\nunion all ".join(unions)


def _both_periods() -> str:
    """The success rates, with a row also for a period without any order."""
    return f"""select k.period, s.success_rate_pct from (values ('fiscal_year'), ('30_days')) as k(period)
    left join ({ship_from_store_success_rate()}) s on s.period = k.period"""


def _grade(value: str, op: str, sla: str, target: str) -> str:
    def reached(limit: str) -> str:
        return f"""(({op} = '<' and {value} < {limit}) or ({op} = '<=' and {value} <= {limit})
          or ({op} = '>' and {value} > {limit}) or ({op} = '>=' and {value} >= {limit}))"""

    return f"""case when {reached(target)} then 'Exceeds SLA' when {reached(sla)} then 'Meets SLA'
      else 'Fails to meet SLA' end"""


def _goal_rows() -> str:
    rows = ", ".join(
        f"({n}, '{src}', '{cat}', '{met}', '{op}', {sla}::double, {tar}::double, '{unit}', '{mid}')"
        for n, (src, cat, met, op, sla, tar, unit, mid) in enumerate(GOALS, 1)
    )
    return f"(values {rows}) as g(row_no, source, category, metric, op, sla, target, unit, metric_id)"


def _text(x: str) -> str:
    return rf"regexp_replace(cast(cast({x} as decimal(28,2)) as varchar), '\.?0+$', '')"


def sla_grade() -> str:
    return f"""
    select g.metric_id, f.fill_rate_pct, g.op, g.sla, g.target, {_grade("f.fill_rate_pct", "g.op", "g.sla", "g.target")}
      as grade
    from {_goal_rows()} cross join (select max(fill_rate_pct) as fill_rate_pct
      from ({fill_rate([365])}) where location_sub_type_id = 'StoreRegular') f"""


def status_fill() -> str:
    fills = " ".join(f"when '{grade}' then '{fill}'" for grade, fill in FILLS.items())
    return f"select *, case grade {fills} end as fill_argb from ({sla_grade()})"


def scorecard() -> str:
    fills = " ".join(f"when '{grade}' then '{fill}'" for grade, fill in FILLS.items())
    return f"""
    select *, case results {fills} end as fill_argb from (
      select g.row_no, g.source as information_source, g.category, g.metric,
        g.op || ' ' || {_text("g.sla")} || g.unit as sla,
        case when g.target in (0, 100) then ' ' || {_text("g.target")}
          else g.op || ' ' || {_text("g.target")} || g.unit end as target,
        coalesce(v.label || ': ', '') || {_text("v.value")} || g.unit as actual,
        {_grade("v.value", "g.op", "g.sla", "g.target")} as results, '' as comment
      from {_goal_rows()} left join ({metric_values()}) v on v.metric_id = g.metric_id)"""


# windows of the registered queries; the test data is thin in the last days
DAYS = [30, 365]
HOURS = 8760


def bodies() -> dict[str, str]:
    """The SQL of every registered query over the logical tables."""
    return {
        "allocation_funnel": allocation_funnel(HOURS),
        "backorder_orders_by_age": backorder_orders_by_age(),
        "backorder_rates": backorder_rates(),
        "blind_return_rate": blind_return_rate(DAYS),
        "blind_returns": blind_returns(DAYS),
        "bopis_cancel_rate": bopis_cancel_rate(365),
        "bopis_lines": bopis_lines(365),
        "bopis_processing_lines": bopis_processing_lines(DAYS),
        "bopis_processing_time": bopis_processing_time(DAYS),
        "bopis_shorts": bopis_shorts(365),
        "bounced_orders": bounced_orders(1),
        "cancel_rate": cancel_rate(DAYS),
        "critical_tickets_created": critical_tickets_created(240),
        "fill_rate": fill_rate(DAYS),
        "fill_rate_gap": fill_rate_gap(DAYS),
        "first_pick_fill_rate": first_pick_fill_rate(DAYS),
        "fulfilment_cancel_share": fulfilment_cancel_share(DAYS),
        "fulfilment_cancel_share_chain": fulfilment_cancel_share(DAYS, chain=True),
        "location_bounced_orders": location_bounced_orders(1),
        "max_cancel_rate": max_cancel_rate(),
        "metric_values": metric_values(),
        "open_critical_tickets": open_critical_tickets(),
        "open_order_rates": open_order_rates(),
        "open_orders_by_age": open_orders_by_age(),
        "payment_failure_rate": payment_failure_rate([7, 30]),
        "payment_failure_rate_max": payment_failure_rate_max([7, 30]),
        "promise_compliance": promise_compliance(DAYS),
        "promise_delivered": promise_delivered(DAYS),
        "promise_released": promise_released(DAYS),
        "promise_shipped": promise_shipped(DAYS),
        "promise_success_rate": promise_success_rate(DAYS),
        "return_rate": return_rate(DAYS),
        "return_to_shelf": return_to_shelf(),
        "scorecard": scorecard(),
        "scorecard_file": scorecard(),
        "ship_from_store_success_rate": ship_from_store_success_rate(),
        "sla_grade": sla_grade(),
        "stale_pick_status": stale_pick_status(),
        "status_fill": status_fill(),
        "store_bounce_rate": store_bounce_rate(365),
        "stuck_in_allocated": stuck_in_allocated(HOURS),
        "ticket_pages": "select ticket_key, project, priority, component, status_category, created from tickets",
        "time_to_release": time_to_release(HOURS),
        "time_to_release_orders": time_to_release_orders(HOURS),
        "time_to_release_cumulative": time_to_release(HOURS, cumulative=True),
        "unique_fill_rate": unique_fill_rate(DAYS),
        "vendor_bounce_rate": vendor_bounce_rate(365),
        "vendor_bounced_orders": vendor_bounced_orders(1),
    }


def texts() -> dict[str, str]:
    """The SQL of every registered query over the base tables."""
    return {name: with_views(f"select * from ({body.strip()})") for name, body in bodies().items()}
