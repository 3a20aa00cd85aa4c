"""The logical tables as views over the generated TPC-H-like test data.

This is test-data definition, not engine code: every view is plain SQL that Spark and DuckDB both accept, so the
metrics and their oracles start from the same rows. See FIXTURES.md section 4.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

BASE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

ORGANISATIONS = ("ITS", "LEA", "LPS", "MP", "PRO", "PSW", "HTW")
ORDER_STATUSES = {
    "1000": "Open",
    "1500": "Back Ordered",
    "2000": "Allocated",
    "3000": "Released",
    "3500": "Packed",
    "3600": "Picked",
    "4500": "Shipped",
    "7000": "Fulfilled",
    "7500": "Delivered",
    "8500": "Returned",
    "9000": "Canceled",
    "18000": "Closed",
}
FULFILMENT_STATUSES = {"1000.000": "New", "3000.000": "Ready for Pickup", "7000.000": "Handed Over", "9000.000": "Canceled"}


def _statuses(descriptions: dict[str, str]) -> str:
    rows = [f"('{s}', '{d}', '{org}')" for s, d in descriptions.items() for org in ORGANISATIONS]
    return f"""
        select *
        from (values {", ".join(rows)}) as t(status, description, profile_id)
    """


VIEWS = {
    "inv_location": """
        select s_suppkey as location_id,
          case s_suppkey % 4 when 0 then 'StoreRegular' when 1 then 'DropShipVendor' when 2 then 'OwnedWM'
              else '3PL' end as location_sub_type_id
        from supplier
    """,
    "org_location": """
        select location_id, location_sub_type_id
        from inv_location
    """,
    "ord_payment_status": """
        select *
        from (values ('0','Awaiting Payment'),('1','Authorized'),('2','Paid')) as t(status_id, short_description)
    """,
    "fw_status_definition": _statuses(ORDER_STATUSES),
    "ful_status_definition": _statuses(FULFILMENT_STATUSES),
    "ord_order": """
        select o_orderkey as pk,
          case when o_orderkey % 50 = 0 then 'CIT' when o_orderkey % 50 = 1 then 'SLE'
              when o_orderkey % 50 = 2 then 'XSHT' else 'ORD' end || cast(o_orderkey as string) as order_id,
          case o_custkey % 7 when 0 then 'ITS' when 1 then 'LEA' when 2 then 'LPS' when 3 then 'MP'
              when 4 then 'PRO' when 5 then 'PSW' else 'HTW' end as org_id,
          o_orderdate + interval '1' second * ((o_orderkey * 7919) % 86400) as created_timestamp,
          o_orderdate + interval '1' second * ((o_orderkey * 7919) % 86400 + (o_orderkey % 5) * 86400) as updated_timestamp,
          o_orderdate + interval '1' second * ((o_orderkey * 7919) % 86400 - (o_orderkey % 40) * 60) as captured_date,
          o_orderdate + interval '1' second * ((o_orderkey % 3) * 3600) as do_not_release_before,
          case when o_orderkey % 20 = 0 then 0 else 1 end as is_confirmed,
          case when o_orderkey % 11 = 0 then 1 else 0 end as is_cancelled,
          o_orderkey % 13 = 0 as is_on_hold,
          o_totalprice as order_total,
          case o_orderstatus when 'O' then case o_orderkey % 4 when 0 then '1500' when 1 then '2000'
              when 2 then '3000' else '3600' end when 'P' then case o_orderkey % 3 when 0 then '4500'
              when 1 then '7000' else '8500' end else case o_orderkey % 3 when 0 then '7000' when 1 then '9000'
              else '18000' end end as max_fulfillment_status_id,
          case when o_orderkey % 9 = 0 then '1000' end as max_return_status_id,
          case when o_orderkey % 6 = 0 then 1 + o_orderkey % 3 when o_orderkey % 6 = 1 then null
              else 0 end as return_line_count,
          case when o_custkey % 4 = 0 then 'blind@example.com' else 'agent@example.com' end as created_by,
          case when o_custkey % 10 = 0 then 'CallCenter' else 'Web' end as selling_channel_id,
          cast(o_orderkey % 3 as string) as payment_status_id
        from orders
    """,
    "ord_order_line": """
        select l.l_orderkey * 10 + l.l_linenumber as pk,
          l.l_orderkey as order_pk,
          o.order_id,
          o.org_id,
          cast(l.l_linenumber as string) as order_line_id,
          cast(min(l.l_partkey) as string) as item_id,
          sum(l.l_quantity) as quantity,
          sum(l.l_extendedprice) as order_line_sub_total,
          case when (l.l_orderkey + l.l_linenumber) % 8 = 0 then sum(l.l_extendedprice)
              else cast(0 as double) end as cancelled_order_line_sub_total,
          o.created_timestamp,
          o.updated_timestamp,
          o.is_on_hold,
          case when (l.l_orderkey + l.l_linenumber) % 8 = 0 then 1 else 0 end as is_cancelled,
          case when (l.l_orderkey + l.l_linenumber) % 8 = 0 then '9000'
              else o.max_fulfillment_status_id end as max_fulfillment_status_id,
          case l.l_linenumber % 4 when 0 then '3000' when 1 then '3600' when 2 then '2000'
              else o.max_fulfillment_status_id end as min_fulfillment_status_id,
          case l.l_linenumber % 3 when 0 then 'ShipToAddress' when 1 then 'PickUpAtStore'
              else 'ShipToStore' end as delivery_method_id,
          case when (l.l_orderkey + l.l_linenumber) % 10 = 3 then 1 else 0 end as is_return,
          case when (l.l_orderkey + l.l_linenumber) % 25 = 4 then 1 else 0 end as is_even_exchange,
          case when l.l_linenumber % 2 = 0 then 'Standard' else 'Gift' end as line_type_id,
          case when l.l_linenumber = 7 then null
              else o.created_timestamp + interval '1' day * 45 end as ext_promise_release_s_l_a,
          max(l.l_shipdate) - interval '1' day * (l.l_linenumber % 3) as promised_ship_date,
          max(l.l_shipdate) + interval '1' day * 3 as promised_delivery_date
        from lineitem l
        join ord_order o on o.pk = l.l_orderkey
        group by l.l_orderkey, l.l_linenumber, o.order_id, o.org_id, o.created_timestamp, o.updated_timestamp,
          o.is_on_hold, o.max_fulfillment_status_id
    """,
    "ord_release": """
        select l.l_orderkey * 100000 + l.l_suppkey as pk,
          l.l_orderkey as order_pk,
          o.order_id,
          cast(l.l_suppkey as string) as release_id,
          l.l_suppkey as ship_from_location_id,
          case l.l_suppkey % 3 when 0 then 'Delivery' when 1 then 'Merge' else 'Pickup' end as destination_action,
          case when l.l_suppkey % 5 < 2 then 'ShipToAddress' else 'PickUpAtStore' end as delivery_method_id,
          min(l.l_shipdate) as created_timestamp
        from lineitem l
        join ord_order o on o.pk = l.l_orderkey
        group by l.l_orderkey, l.l_suppkey, o.order_id
    """,
    "ord_release_line": """
        select l_orderkey * 100000 + l_suppkey as release_pk,
          cast(l_linenumber as string) as order_line_id,
          l_linenumber as release_line_id,
          cast(l_partkey as string) as item_id,
          l_quantity as quantity,
          case l_returnflag when 'N' then l_quantity when 'A' then cast(floor(l_quantity / 2) as double)
              else cast(0 as double) end as fulfilled_quantity,
          case when l_returnflag = 'R' then l_quantity
              when l_returnflag = 'A' and l_linestatus = 'F' then l_quantity - cast(floor(l_quantity / 2) as double)
              else cast(0 as double) end as cancelled_quantity,
          l_shipdate as created_timestamp
        from lineitem
    """,
    "ord_order_line_cancel_history": """
        select pk as order_line_pk, quantity as cancel_quantity
        from ord_order_line
        where is_cancelled = 1
    """,
    "ord_order_milestone": """
        select pk as order_pk,
          'Order::Milestone::Allocated' as milestone_definition_id,
          created_timestamp + interval '1' minute * (pk % 15) as created_timestamp,
          created_timestamp + interval '1' minute * (pk % 15) as updated_timestamp
        from ord_order
        union all
        select pk,
          'Order::Milestone::Released',
          created_timestamp,
          created_timestamp + interval '1' minute * (15 + pk % 300)
        from ord_order
        where pk % 5 <> 0
    """,
    "ord_quantity_detail": """
        select pk as order_line_pk, org_id, '1000' as status_id, created_by, created_timestamp
        from (select l.pk, l.org_id, o.created_by, l.created_timestamp
        from ord_order_line l
        join ord_order o on o.pk = l.order_pk) a
        union all
        select pk,
          org_id,
          '3000',
          'system@example.com',
          created_timestamp + interval '1' minute * (pk % 240)
        from ord_order_line
        where pk % 3 <> 0
    """,
    "ord_fulfillment_detail": """
        select l_orderkey * 10 + l_linenumber as order_line_pk,
          cast(l_suppkey as string) as release_id,
          l_linenumber as release_line_id,
          case l_linestatus when 'F' then '7500' else '7000' end as status_id,
          l_shipdate + interval '1' hour * (l_partkey % 72 - 36) as fulfillment_date,
          'T' || cast(l_orderkey as string) || '-' || cast(l_suppkey as string) as tracking_number
        from lineitem
        where l_returnflag <> 'R'
    """,
    "ord_order_tracking_info": """
        select l_orderkey as order_pk,
          'T' || cast(l_orderkey as string) || '-' || cast(l_suppkey as string) as tracking_number,
          case when l_suppkey % 9 = 0 then null
              else max(l_shipdate) + interval '1' day * (l_suppkey % 7) end as delivered_date
        from lineitem
        group by l_orderkey, l_suppkey
    """,
    "pay_payment_method": """
        select c_custkey as pk,
          case c_custkey % 4 when 0 then 'VISA' when 1 then 'MASTERCARD' when 2 then 'American Express'
              else 'DISCOVER' end as card_type,
          case c_custkey % 6 when 0 then 'PayPal' when 1 then 'Gift Card' when 2 then 'AR Credit'
              else 'Credit Card' end as payment_type
        from customer
    """,
    "pay_payment_transaction": """
        select e.event_id as payment_transaction_id,
          e.user_id as payment_method_pk,
          o.order_id,
          case when e.event_type in ('purchase','error','click') then 'Authorization'
              else 'Settlement' end as transaction_type,
          case when e.event_type = 'error' then 'Failure' else 'Success' end as payment_response_status,
          e.ts as created_timestamp
        from events e
        join ord_order o on o.pk = e.event_id
    """,
    "ful_fulfillment": """
        select r.pk, 'F' || cast(r.pk as string) as fulfillment_id,
          r.order_id,
          r.ship_from_location_id,
          r.ship_from_location_id as ship_to_location_id,
          c.c_name as customer_first_name,
          c.c_mktsegment as customer_last_name,
          r.delivery_method_id,
          case when o.org_id = 'MP' then 'Marketplace' else 'Retail' end as order_type_id,
          case when r.pk % 10 = 0 then 'Customer' end as cancel_reason_id,
          r.created_timestamp,
          r.created_timestamp + interval '1' day * 7 as pickup_expiry_date
        from ord_release r
        join ord_order o on o.pk = r.order_pk
        join orders t on t.o_orderkey = r.order_pk
        join customer c on c.c_custkey = t.o_custkey
    """,
    "ful_fulfillment_line": """
        select (l_orderkey * 100000 + l_suppkey) * 10 + l_linenumber as pk,
          l_orderkey * 100000 + l_suppkey as fulfillment_pk,
          o.order_id,
          cast(min(l_partkey) as string) as item_id,
          sum(l_quantity) as ordered_qty,
          min(p.p_retailprice) as item_unit_price,
          case when min(l_returnflag) = 'R' then sum(l_quantity) else cast(0 as double) end as cancelled_qty,
          case min(l_returnflag) when 'R' then '9000.000' when 'A' then '3000.000'
              else '7000.000' end as fulfillment_line_status_id,
          min(l_shipdate) as created_timestamp
        from lineitem
        join ord_order o on o.pk = l_orderkey
        join part p on p.p_partkey = l_partkey
        group by l_orderkey, l_suppkey, l_linenumber, o.order_id
    """,
    "ful_fulfillment_line_shorts": """
        select pk as fulfillment_line_pk,
          case pk % 3 when 0 then 'OutOfStock' when 1 then 'Damaged' else 'NotFound' end as short_reason_id,
          created_timestamp + interval '1' hour as updated_timestamp
        from ful_fulfillment_line
        where fulfillment_line_status_id = '9000.000'
    """,
    "tickets": """
        select 'OPS-' || cast(event_id as string) as ticket_key, 'Order Desk' as project,
          case user_id % 4 when 0 then 'critical' when 1 then 'major' else 'minor' end as priority,
          case event_id % 5 when 0 then 'critical' when 1 then 'payments' else 'orders' end as component,
          case event_id % 3 when 0 then 'To Do' when 1 then 'In Progress' else 'Done' end as status_category,
          ts as created
        from events
        where event_type in ('error','signup')
    """,
}


def needed_views(sql: str) -> list[str]:
    """Names of the views that ``sql`` reads, directly or through other views, in definition order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & VIEWS.keys() - wanted:
            wanted.add(name)
            todo.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str, base: dict[str, str] | None = None) -> str:
    """Prepend to ``sql`` the views it needs as CTEs, after the CTEs of ``base`` that those views need."""
    names = needed_views(sql)
    words = set(re.findall(r"\w+", " ".join([sql] + [VIEWS[n] for n in names])))
    ctes = [f"{name} as ({text})" for name, text in (base or {}).items() if name in words]
    ctes += [f"{name} as ({VIEWS[name].strip()})" for name in names]
    return f"with {', '.join(ctes)}\n{sql}" if ctes else sql


def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The logical tables derived from the Parquet files in ``sf_dir``; each is analysed on first use."""
    base = {name: f"select * from parquet.`{sf_dir}/{name}.parquet`" for name in BASE_TABLES}

    def load(name: str) -> DataFrame:
        if name not in VIEWS:
            raise KeyError(name)
        return spark.sql(with_views(f"select * from {name}", base))

    return Tables(load)
