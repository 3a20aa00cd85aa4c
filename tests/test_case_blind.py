"""Texts that differ in case only are equal: in filters, joins, groups and distincts, whatever reads them."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_queries
from ordergauge.functions.texts import aggregated, case_blind, distinct_rows, is_case_blind
from ordergauge.operators import fill, payments
from ordergauge.plans import metrics, scorecard
from ordergauge.plans.shared import with_stored_facts
from ordergauge.sources.layout import write_tables
from ordergauge.sources.schemas import SCHEMAS, TEXTS
from ordergauge.sources.tables import parquet_tables
from tests.random_rows import mixed_case, random_rows
from tests.support import duck_result, duck_tables, spark_result, spark_tables
from tests.test_scale import plan_of, pruned_scans

NAMES = [name for name in sorted(entry.operators()) if name not in ("metric_values", "scorecard", "scorecard_file", "ticket_pages")]


def lowered(result):
    names, rows = result
    return names, sorted(tuple(x.lower() for x in row) for row in rows)


def blind_sql(name):
    """The oracle text of a query; the database's list functions know no collation, its lists of values do."""
    body = re.sub(r"list_contains\(\[(.*?)\], ([\w.]+)\)", r"\2 in (\1)", oracle_queries.bodies()[name])
    return re.sub(r"list_position\((.*?), a.org_id\)", r"list_position(\1, upper(a.org_id))", body)


@pytest.fixture(scope="module")
def spelled(spark):
    """Tables of random rows, the same rows in mixed case, and these in a database that compares without case."""
    rows = random_rows(11, 200)
    mixed = mixed_case(rows)
    texts = {(k, v) for table in mixed.values() for row in table for k, v in row.items() if k in TEXTS and v}
    assert len({(k, v.lower()) for k, v in texts}) < len(texts) / 3
    given = spark_tables(spark, rows), spark_tables(spark, mixed)
    for tables in given:
        for name in rows:
            tables[name].cache()
    return *given, duck_tables(mixed)


@pytest.mark.parametrize("name", NAMES)
def test_case_changes_no_result(spark, spelled, name):
    plain, mixed, connection = spelled
    build = entry.operators()[name]
    result = build(spark, mixed)
    assert not any(is_case_blind(f.dataType) for f in result.schema.fields)
    found = lowered(spark_result(result))
    assert found == lowered(duck_result(connection, blind_sql(name)))
    assert found == lowered(spark_result(build(spark, plain)))


def test_the_scorecard_too(spark, spelled):
    plain, mixed, _ = spelled
    goals = scorecard.goals(spark)
    cards = [scorecard.scorecard(metrics.metric_values(t, entry.SETTINGS), goals) for t in (plain, mixed)]
    assert lowered(spark_result(cards[0])) == lowered(spark_result(cards[1]))


def test_upper_case_transaction_types(spark):
    rows = random_rows(3, 60)
    for row in rows["pay_payment_transaction"]:
        for column in ("transaction_type", "payment_response_status"):
            row[column] = row[column] and row[column].upper()
    tables = spark_tables(spark, rows)
    assert payments.payment_failure_rate(tables, oracle_queries.PAYMENT_AS_OF, [7, 30]).count() > 0


def test_a_group_shows_its_least_spelling(spark):
    rows = spark.createDataFrame([("Visa", 1), ("VISA", 2), ("visa", 4), (None, 8), ("amex", 16)], "card string, n int")
    blind = case_blind(rows, ["card"])
    found = aggregated(blind, ["card"], F.sum("n").alias("n"))
    assert {tuple(r) for r in found.collect()} == {("VISA", 7), (None, 8), ("amex", 16)}
    # and stays without case for what reads it
    assert is_case_blind(found.schema["card"].dataType) and found.filter(F.col("card") == "viSA").count() == 1
    assert {r.card for r in distinct_rows(blind.select("card")).collect()} == {"VISA", None, "amex"}
    assert blind.alias("a").join(blind.alias("b"), "card").count() == 9 + 1
    assert aggregated(rows, ["card"], F.sum("n").alias("n")).count() == 5


def test_groups_are_hashed_and_filters_reach_the_scan(spark, tmp_path):
    write_tables(spark_tables(spark, mixed_case(random_rows(5, 40))), SCHEMAS, str(tmp_path), grain="month")
    tables = parquet_tables(spark, str(tmp_path))
    plan = plan_of(fill.fill_rate(tables, entry.AS_OF, 7))
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "GreaterThan(created_timestamp,2001-07-26T00:00)" in plan and pruned_scans(plan, "created_timestamp_month")
    plan = plan_of(payments.payment_failure_rate(tables, entry.PAYMENT_AS_OF, 30))
    assert "SortAggregate" not in plan and pruned_scans(plan, "created_timestamp_month")
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
    assert "GreaterThanOrEqual(created_timestamp" in pushed and "IsNotNull(transaction_type)" in pushed
    # codes and ids keep byte order, and their filters reach the scan whole
    plan = plan_of(entry.operators()["promise_shipped"](spark, tables))
    assert "In(status_id, [7000,7500])" in plan


def test_stored_joins_keep_the_comparison(spark, spelled):
    stored = with_stored_facts(spark, spelled[1])
    for name in ("first_pick_fill_rate", "ship_from_store_success_rate", "open_orders_by_age", "promise_shipped"):
        build = entry.operators()[name]
        assert lowered(spark_result(build(spark, stored))) == lowered(spark_result(build(spark, spelled[0])))
