"""Column names and types of the logical tables (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import case_blind

_COLUMNS = {
    "inv_location": "location_id bigint, location_sub_type_id string",
    "org_location": "location_id bigint, location_sub_type_id string",
    "ord_payment_status": "status_id string, short_description string",
    "fw_status_definition": "status string, description string, profile_id string",
    "ful_status_definition": "status string, description string, profile_id string",
    "ord_order": """
        pk bigint, order_id string, org_id string, created_timestamp timestamp_ntz, updated_timestamp timestamp_ntz,
        captured_date timestamp_ntz, do_not_release_before timestamp_ntz, is_confirmed int, is_cancelled int,
        is_on_hold boolean, order_total double, max_fulfillment_status_id string, max_return_status_id string,
        return_line_count bigint, created_by string, selling_channel_id string, payment_status_id string""",
    "ord_order_line": """
        pk bigint, order_pk bigint, order_id string, org_id string, order_line_id string, item_id string,
        quantity double, order_line_sub_total double, cancelled_order_line_sub_total double,
        created_timestamp timestamp_ntz, updated_timestamp timestamp_ntz, is_on_hold boolean, is_cancelled int,
        max_fulfillment_status_id string, min_fulfillment_status_id string, delivery_method_id string,
        is_return int, is_even_exchange int, line_type_id string, ext_promise_release_s_l_a timestamp_ntz,
        promised_ship_date timestamp_ntz, promised_delivery_date timestamp_ntz""",
    "ord_release": """
        pk bigint, order_pk bigint, order_id string, release_id string, ship_from_location_id bigint,
        destination_action string, delivery_method_id string, created_timestamp timestamp_ntz""",
    "ord_release_line": """
        release_pk bigint, order_line_id string, release_line_id int, item_id string, quantity double,
        fulfilled_quantity double, cancelled_quantity double, created_timestamp timestamp_ntz""",
    "ord_order_line_cancel_history": "order_line_pk bigint, cancel_quantity double",
    "ord_order_milestone": """
        order_pk bigint, milestone_definition_id string, created_timestamp timestamp_ntz,
        updated_timestamp timestamp_ntz""",
    "ord_quantity_detail": """
        order_line_pk bigint, org_id string, status_id string, created_by string, created_timestamp timestamp_ntz""",
    "ord_fulfillment_detail": """
        order_line_pk bigint, release_id string, release_line_id int, status_id string,
        fulfillment_date timestamp_ntz, tracking_number string""",
    "ord_order_tracking_info": "order_pk bigint, tracking_number string, delivered_date timestamp_ntz",
    "pay_payment_method": "pk bigint, card_type string, payment_type string",
    "pay_payment_transaction": """
        payment_transaction_id bigint, payment_method_pk bigint, order_id string, transaction_type string,
        payment_response_status string, created_timestamp timestamp_ntz""",
    "ful_fulfillment": """
        pk bigint, fulfillment_id string, order_id string, ship_from_location_id bigint, ship_to_location_id bigint,
        customer_first_name string, customer_last_name string, delivery_method_id string, order_type_id string,
        cancel_reason_id string, created_timestamp timestamp_ntz, pickup_expiry_date timestamp_ntz""",
    "ful_fulfillment_line": """
        pk bigint, fulfillment_pk bigint, order_id string, item_id string, ordered_qty double,
        item_unit_price double, cancelled_qty double, fulfillment_line_status_id string,
        created_timestamp timestamp_ntz""",
    "ful_fulfillment_line_shorts": """
        fulfillment_line_pk bigint, short_reason_id string, updated_timestamp timestamp_ntz""",
    "tickets": """
        ticket_key string, project string, priority string, component string, status_category string,
        created timestamp_ntz""",
}

# Columns that hold words, not ids or codes: the source databases compare them without case.
TEXTS = frozenset(
    """
    location_sub_type_id short_description description profile_id org_id created_by selling_channel_id
    delivery_method_id line_type_id destination_action milestone_definition_id card_type payment_type
    transaction_type payment_response_status order_type_id cancel_reason_id short_reason_id
    customer_first_name customer_last_name project priority component status_category
    """.split()
)

SCHEMAS: dict[str, str] = {name: " ".join(ddl.split()) for name, ddl in _COLUMNS.items()}


def columns_of(name: str) -> dict[str, str]:
    """Column names and types of a logical table."""
    return dict(item.split() for item in SCHEMAS[name].split(", "))


def conformed(name: str, df: DataFrame) -> DataFrame:
    """``df`` with the column names of the logical table ``name``, its kinds of flags and codes, and texts without case.

    Databases give flags as booleans or numbers and status codes as text or numbers. Timestamps with or without zone and
    decimal or double numbers are all fine as they are, as are further columns.
    """
    return case_blind(_columns_conformed(name, df), TEXTS & columns_of(name).keys())


def _columns_conformed(name: str, df: DataFrame) -> DataFrame:
    actual = {field.name.lower(): field for field in df.schema.fields}
    missing = [column for column in columns_of(name) if column not in actual]
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}")
    changed = {}
    for column, kind in columns_of(name).items():
        field = actual[column]
        given = field.dataType.typeName()
        wrong_flag = (kind == "boolean") != (given == "boolean") and kind in ("boolean", "int")
        wrong_code = kind == "string" and not given.startswith(("string", "char", "varchar"))
        if wrong_flag or wrong_code:
            changed[column] = F.col(field.name).cast(kind).alias(column)
        elif field.name != column:
            changed[column] = F.col(field.name).alias(column)
    if not changed:
        return df
    return df.select(*[changed.get(field.name.lower(), F.col(field.name)) for field in df.schema.fields])
