"""Random logical tables with NULLs, copies, odd status codes and times on the window boundaries."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from oracle_queries import ACCOUNT, AS_OF, PAYMENT_AS_OF, PROJECT
from ordergauge.sources.schemas import TEXTS

NOW = datetime.fromisoformat(AS_OF)
PAY_NOW = datetime.fromisoformat(PAYMENT_AS_OF)
ORGS = ["ITS", "LEA", "LPS", "MP", "PRO", "PSW", "HTW"]
STATUSES = ["1000", "1500", "2000", "3000", "3600", "4500", "7000", "8500", "9000", "18000", "3000.000", "odd", None]
KINDS = ["StoreRegular", "DropShipVendor", "OwnedWM", "3PL"]
DESCRIPTIONS = {
    "1000": "Open",
    "1500": "Back Ordered",
    "2000": "Allocated",
    "3000": "Released",
    "3600": "Picked",
    "4500": "Shipped",
    "7000": "Fulfilled",
    "9000": "Canceled",
    "18000": "Closed",
    "3000.000": "Ready for Pickup",
}


def random_rows(seed: int, orders: int = 150) -> dict[str, list[dict]]:
    r = random.Random(seed)

    def maybe(value, nulls: float = 0.06):
        return None if r.random() < nulls else value

    def moment(now: datetime = NOW) -> datetime:
        if r.random() < 0.35:
            days = r.choice([0, 1, 2, 3, 5, 7, 10, 30, 60, 200, 365])
            return now - timedelta(days=days, seconds=r.choice([-1, 0, 1]))
        return now - timedelta(seconds=r.randint(-86400, 86400 * r.choice([2, 8, 40, 400])))

    def near(time: datetime | None, hours: int = 60) -> datetime | None:
        if time is None:
            return None
        return time + timedelta(hours=r.randint(-hours, hours), seconds=r.choice([-1, 0, 0, 1, 7199, 3600]))

    def copies(row: dict) -> list[dict]:
        return [row] * r.choice([1, 1, 1, 2, 3])

    t: dict[str, list[dict]] = {}
    t["inv_location"] = [{"location_id": i, "location_sub_type_id": KINDS[i % 4]} for i in range(12)]
    t["org_location"] = [{"location_id": i, "location_sub_type_id": KINDS[i % 4]} for i in range(11)]
    t["ord_payment_status"] = [{"status_id": str(i), "short_description": f"state {i}"} for i in range(3)]
    any_case = lambda text: r.choice([text, text, text.upper(), text.lower()])
    t["fw_status_definition"] = [
        {"status": s, "description": any_case(d), "profile_id": org} for s, d in DESCRIPTIONS.items() for org in ORGS
    ]
    # a code of both tables means something else in each
    t["ful_status_definition"] = [
        {"status": s, "description": f"of fulfilment {s}", "profile_id": org}
        for s in ("3000.000", "9000.000", "7000.000")
        for org in ORGS
    ]
    for name in (
        "ord_order ord_order_line ord_release ord_release_line ord_order_line_cancel_history ord_order_milestone "
        "ord_quantity_detail ord_fulfillment_detail ord_order_tracking_info pay_payment_method "
        "pay_payment_transaction ful_fulfillment ful_fulfillment_line ful_fulfillment_line_shorts tickets"
    ).split():
        t[name] = []

    for pk in range(orders):
        order_id = r.choice(["CIT", "SLE", "xsle", "ORD", "ORD", "ORD", "ORD"]) + str(pk) + r.choice(["", "", "SHT"])
        org = maybe(r.choice(ORGS), 0.02)
        created = moment()
        t["ord_order"].append(
            {
                "pk": pk,
                "order_id": order_id,
                "org_id": org,
                "created_timestamp": created,
                "updated_timestamp": maybe(moment()),
                "captured_date": maybe(near(created, 3)),
                "do_not_release_before": maybe(near(created)),
                "is_confirmed": maybe(r.choice([0, 1, 1, 1])),
                "is_cancelled": maybe(r.choice([0, 0, 0, 1])),
                "is_on_hold": maybe(r.choice([False, False, True])),
                "order_total": maybe(r.choice([0.0, 10.5, 99.99])),
                "max_fulfillment_status_id": r.choice(STATUSES),
                "max_return_status_id": maybe("1000", 0.8),
                "return_line_count": maybe(r.choice([0, 1, 2]), 0.2),
                "created_by": maybe(r.choice([ACCOUNT, "agent@example.com"])),
                "selling_channel_id": maybe(r.choice(["Web", "Web", "Web", "CallCenter"])),
                "payment_status_id": r.choice(["0", "1", "2", "9"]),
            }
        )
        for kind in ("Allocated", "Released"):
            if r.random() < 0.8:
                at = near(created, 3)
                row = {
                    "order_pk": pk,
                    "milestone_definition_id": f"Order::Milestone::{kind}",
                    "created_timestamp": maybe(at),
                    "updated_timestamp": maybe(near(at, 2)),
                }
                t["ord_order_milestone"] += copies(row)

        lines = [str(n) for n in range(r.randint(0, 4))]
        for line_id in lines:
            line_pk = pk * 10 + int(line_id)
            line_created = maybe(near(created, 30))
            t["ord_order_line"].append(
                {
                    "pk": line_pk,
                    "order_pk": pk,
                    "order_id": order_id,
                    "org_id": org,
                    "order_line_id": line_id,
                    "item_id": f"item {r.randint(0, 9)}",
                    "quantity": maybe(float(r.randint(0, 9))),
                    "order_line_sub_total": maybe(r.randint(0, 99999) / 100),
                    "cancelled_order_line_sub_total": maybe(r.randint(0, 99999) / 100),
                    "created_timestamp": line_created,
                    "updated_timestamp": maybe(moment()),
                    "is_on_hold": maybe(r.choice([False, True])),
                    "is_cancelled": maybe(r.choice([0, 0, 1])),
                    "max_fulfillment_status_id": r.choice([*STATUSES, "9000", "9000"]),
                    "min_fulfillment_status_id": r.choice(STATUSES),
                    "delivery_method_id": maybe(any_case(r.choice(["ShipToAddress", "PickUpAtStore", "ShipToStore"]))),
                    "is_return": maybe(r.choice([0, 0, 0, 1])),
                    "is_even_exchange": maybe(r.choice([0, 0, 0, 1])),
                    "line_type_id": maybe(r.choice(["Standard", "Gift"])),
                    "ext_promise_release_s_l_a": maybe(r.choice([NOW, near(created), near(created)])),
                    "promised_ship_date": maybe(near(created)),
                    "promised_delivery_date": maybe(near(created)),
                }
            )
            for _ in range(r.choice([0, 0, 1, 2])):
                row = {"order_line_pk": line_pk, "cancel_quantity": maybe(float(r.randint(0, 3)))}
                t["ord_order_line_cancel_history"] += copies(row)
            for status in ("1000", "3000"):
                row = {
                    "order_line_pk": line_pk,
                    "org_id": org,
                    "status_id": status,
                    "created_timestamp": maybe(near(created, 3)),
                }
                t["ord_quantity_detail"] += copies(row) if r.random() < 0.8 else []

        if r.random() < 0.08:
            # order lines are gone, their releases are not
            gone = {x["pk"] for x in t["ord_order_line"] if x["order_pk"] == pk}
            t["ord_order_line"] = [x for x in t["ord_order_line"] if x["pk"] not in gone]
        for n in range(r.choice([0, 1, 2, 3, 5])):
            release_pk, release_id = pk * 100 + n, f"R{n}"
            location = r.randint(0, 13)
            release_created = maybe(near(created), 0.15)
            t["ord_release"].append(
                {
                    "pk": release_pk,
                    "order_pk": pk,
                    "order_id": order_id,
                    "release_id": release_id,
                    "ship_from_location_id": location,
                    "destination_action": maybe(any_case(r.choice(["Delivery", "Merge", "Pickup"]))),
                    "delivery_method_id": maybe(r.choice(["ShipToAddress", "PickUpAtStore"])),
                    "created_timestamp": release_created,
                }
            )
            t["ful_fulfillment"].append(
                {
                    "pk": release_pk,
                    "fulfillment_id": f"F{release_pk}",
                    "order_id": order_id,
                    "ship_from_location_id": location,
                    "ship_to_location_id": location,
                    "customer_first_name": maybe("Ann"),
                    "customer_last_name": maybe("Lee"),
                    "delivery_method_id": maybe(any_case(r.choice(["ShipToAddress", "PickUpAtStore", "PickUpAtStore"]))),
                    "order_type_id": maybe(any_case(r.choice(["Marketplace", "Retail", "Retail"]))),
                    "cancel_reason_id": maybe("Customer", 0.7),
                    "created_timestamp": created,
                    "pickup_expiry_date": maybe(moment()),
                }
            )
            for line_id in lines:
                if r.random() < 0.4:
                    continue
                line_number = maybe(r.choice([int(line_id), int(line_id) + 1]), 0.05)
                quantity = r.randint(0, 5)
                row = {
                    "release_pk": release_pk,
                    "order_line_id": line_id,
                    "release_line_id": line_number,
                    "item_id": f"item {r.randint(0, 2)}",
                    "quantity": maybe(float(quantity)),
                    "fulfilled_quantity": maybe(float(r.randint(0, quantity))),
                    "cancelled_quantity": maybe(float(r.choice([0, 0, r.randint(0, quantity)]))),
                    "created_timestamp": maybe(moment()),
                }
                t["ord_release_line"] += copies(row)
                if r.random() < 0.1:
                    # a line that the order does not have, of an order that may have none left
                    t["ord_release_line"].append(row | {"order_line_id": "77"})
                detail = {
                    "order_line_pk": pk * 10 + int(line_id),
                    "release_id": release_id,
                    "release_line_id": line_number,
                    "status_id": r.choice(["7000", "7500", "7500", "1000"]),
                    "fulfillment_date": maybe(near(created)),
                    "tracking_number": maybe(f"T{pk}-{n}"),
                }
                t["ord_fulfillment_detail"] += copies(detail)
                line_pk = release_pk * 10 + int(line_id)
                t["ful_fulfillment_line"].append(
                    {
                        "pk": line_pk,
                        "fulfillment_pk": release_pk,
                        "order_id": order_id,
                        "item_id": f"item {r.randint(0, 2)}",
                        "ordered_qty": maybe(float(r.randint(1, 3))),
                        "item_unit_price": maybe(r.randint(0, 9999) / 100),
                        "cancelled_qty": maybe(float(r.randint(0, 3))),
                        "fulfillment_line_status_id": r.choice(["9000.000", "3000.000", "7000.000", None]),
                        "created_timestamp": maybe(moment()),
                    }
                )
                short = {
                    "fulfillment_line_pk": line_pk,
                    "short_reason_id": maybe(r.choice(["OutOfStock", "Damaged"])),
                    "updated_timestamp": maybe(moment()),
                }
                t["ful_fulfillment_line_shorts"] += copies(short) if r.random() < 0.7 else []
            parcel = {"order_pk": pk, "tracking_number": f"T{pk}-{n}", "delivered_date": maybe(near(created))}
            t["ord_order_tracking_info"] += copies(parcel)

        for n in range(r.choice([0, 1, 3])):
            t["pay_payment_transaction"].append(
                {
                    "payment_transaction_id": pk * 10 + n,
                    "payment_method_pk": r.randint(0, 11),
                    "order_id": order_id,
                    "transaction_type": r.choice(["Authorization", "Authorization", "Settlement"]),
                    "payment_response_status": maybe(r.choice(["Success", "Failure"])),
                    "created_timestamp": maybe(moment(PAY_NOW)),
                }
            )
    cards = ["VISA", "MASTERCARD", "American Express", None]
    t["pay_payment_method"] = [
        {"pk": i, "card_type": cards[i % 4], "payment_type": r.choice(["Credit Card", "Credit Card", "PayPal", None])}
        for i in range(10)
    ]
    for n in range(60):
        t["tickets"].append(
            {
                "ticket_key": f"T-{n}",
                "project": r.choice([PROJECT, PROJECT, "Other"]),
                "priority": maybe(r.choice(["critical", "major"])),
                "component": maybe(r.choice(["critical", "orders"])),
                "status_category": maybe(r.choice(["To Do", "Done"])),
                "created": maybe(moment(PAY_NOW)),
            }
        )
    return t


def mixed_case(rows: dict[str, list[dict]], seed: int = 1) -> dict[str, list[dict]]:
    """The rows with every text spelled in a case of its own, copies too."""
    r = random.Random(seed)

    def spelled(text: str) -> str:
        return r.choice([text, text.upper(), text.lower(), text.swapcase(), "".join(r.choice([c, c.swapcase()]) for c in text)])

    return {
        name: [{k: spelled(v) if k in TEXTS and v is not None else v for k, v in row.items()} for row in table]
        for name, table in rows.items()
    }
