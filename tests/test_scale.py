"""Plans and storage: what is read, how it is joined, and what a hot key does."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ordergauge.functions.times import since
from ordergauge.operators import aging, fill
from ordergauge.plans import metrics
from ordergauge.plans.shared import with_stored_facts
from ordergauge.session import shared_folder, size_shuffles
from ordergauge.sources.layout import write_tables
from ordergauge.sources.samples import VIEWS, sample_tables
from ordergauge.sources.schemas import SCHEMAS, columns_of
from ordergauge.sources.tables import catalog_tables, jdbc_options, parquet_tables
from tests.random_rows import NOW, random_rows
from tests.support import duck_result, duck_tables, spark_result, spark_tables

SF_DIR = "/root/testdata/sf0.001"
OPERATORS = [name for name in sorted(entry.operators()) if name not in ("metric_values", "scorecard", "scorecard_file", "ticket_pages")]


@pytest.fixture(scope="module")
def stored(spark):
    """The test data laid out by month."""
    folder = shared_folder(spark)
    write_tables(sample_tables(spark, SF_DIR), VIEWS, folder, grain="month")
    return parquet_tables(spark, folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pruned_scans(plan, column):
    """The scans that skip partitions by ``column``."""
    return re.findall(rf"PartitionFilters: \[[^\]]*{column}", plan)


@pytest.mark.parametrize("name", OPERATORS)
def test_plans_have_no_cross_joins_and_no_python(spark, stored, name):
    plan = plan_of(entry.operators()[name](spark, stored))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python", plan)


@pytest.mark.parametrize("name", ["fill_rate", "open_orders_by_age", "promise_success_rate", "return_rate"])
def test_layout_by_month_gives_the_same_rows(spark, stored, name):
    build = entry.operators()[name]
    assert spark_result(build(spark, stored)) == spark_result(build(spark, sample_tables(spark, SF_DIR)))


def test_windows_skip_partitions(spark, stored):
    recent = since(stored["ord_order"], "created_timestamp", NOW.replace(month=7, day=20))
    assert pruned_scans(plan_of(recent), "created_timestamp_month")
    assert {r[0].month for r in recent.select("created_timestamp_month").distinct().collect()} <= {7, 8}
    # also through the join with lines and the renamed column
    lines = since(stored.line_facts, "order_created", NOW.replace(month=7, day=20))
    assert pruned_scans(plan_of(lines), "created_timestamp_month")


def test_filters_and_columns_reach_the_scan(spark, stored):
    plan = plan_of(fill.fill_rate(stored, entry.AS_OF, 7))
    assert "GreaterThan(created_timestamp,2001-07-26T00:00)" in plan
    scans = [set(re.findall(r"(\w+)#", columns)) for columns in re.findall(r"FileScan parquet \[(.*?)\]", plan)]
    needed = {"release_pk", "fulfilled_quantity", "cancelled_quantity", "created_timestamp"}
    # and the partition columns, which take no reading
    assert needed | {"created_timestamp_month", "order_created_month"} in scans


def test_replacing_a_table_forgets_the_joins_made_of_it(spark, stored):
    shared = with_stored_facts(spark, stored)
    assert shared.spine.columns  # a join planned before must not be taken over
    old = F.col("created_timestamp") < F.lit("2001-07-20").cast("timestamp_ntz")
    for name in ("ord_release", "ord_order_line"):
        kept = {name: stored[name].filter(~old)}
        assert 0 < kept[name].count() < stored[name].count()
        for metric in (fill.first_pick_fill_rate, fill.unique_fill_rate, fill.fill_rate_gap):
            plain = spark_result(metric(stored.replaced(kept), entry.AS_OF, 30))
            assert spark_result(metric(shared.replaced(kept), entry.AS_OF, 30)) == plain
    # a table that is in no join leaves them as they are
    others = shared.replaced({"tickets": stored["tickets"]})
    assert others.spine.inputFiles() == shared.spine.inputFiles()


def test_a_stored_spine_is_scanned_once_without_joins(spark, stored):
    tables = with_stored_facts(spark, stored, grain="month")
    plan = plan_of(aging.open_orders_by_age(tables, entry.AS_OF))
    assert "Join" not in plan
    assert plan.count("FileScan") == 1
    assert pruned_scans(plan, "order_created_month")
    assert spark_result(aging.open_orders_by_age(tables, entry.AS_OF)) == spark_result(
        aging.open_orders_by_age(stored, entry.AS_OF)
    )


@pytest.mark.parametrize(
    "name, tables_cut",
    [
        ("first_pick_fill_rate", 2),  # orders and releases
        ("open_orders_by_age", 2),
        ("promise_shipped", 3),  # and fulfilment details
        ("ship_from_store_success_rate", 2),
        ("time_to_release", 4),  # orders and milestones, for either side
        ("time_to_release_orders", 4),
    ],
)
def test_windows_on_orders_skip_partitions_of_what_belongs_to_them(spark, stored, name, tables_cut):
    build = entry.operators()[name]
    plan = plan_of(build(spark, stored))
    cut = [x for x in re.findall(r"PartitionFilters: \[[^\]]*\]", plan) if "_month" in x and ">=" in x]
    assert len(cut) >= tables_cut
    assert spark_result(build(spark, stored)) == spark_result(build(spark, sample_tables(spark, SF_DIR)))


@pytest.mark.parametrize("grain", ["date", "month"])
def test_layout_keeps_rows_without_time_or_order(spark, tmp_path, grain):
    rows = random_rows(21, 40)
    rows["ord_order"] = [r | {"created_timestamp": None} if r["pk"] % 9 == 0 else r for r in rows["ord_order"]]
    rows["ord_order_milestone"].append({"order_pk": 10_000, "milestone_definition_id": "Order::Milestone::Released"})
    plain = spark_tables(spark, rows)
    write_tables(plain, SCHEMAS, str(tmp_path), grain=grain)
    laid_out = parquet_tables(spark, str(tmp_path))
    for name in ("ord_order", "ord_release", "ord_order_milestone", "ord_fulfillment_detail"):
        assert laid_out[name].count() == plain[name].count()
    for name in ("bounced_orders", "promise_shipped", "promise_delivered", "stale_pick_status", "time_to_release"):
        build = entry.operators()[name]
        assert spark_result(build(spark, laid_out)) == spark_result(build(spark, plain))


def test_a_report_reads_the_stored_spine_a_few_times(spark, stored):
    tables = with_stored_facts(spark, stored)
    folder = os.path.dirname(tables.spine.inputFiles()[0])
    plan = plan_of(metrics.metric_values(tables, entry.SETTINGS))
    spine = {column for column in tables.spine.columns if column not in tables.line_facts.columns}
    scans = [c for c in re.findall(r"FileScan parquet \[(.*?)\]", plan) if spine & set(re.findall(r"(\w+)#", c))]
    assert os.path.basename(folder) == "spine" and 0 < sum("sub_type" in c for c in scans) <= 11


HOT_QUERIES = [
    "bopis_processing_time",
    "bounced_orders",
    "cancel_rate",
    "fill_rate",
    "fill_rate_gap",
    "first_pick_fill_rate",
    "open_orders_by_age",
    "payment_failure_rate",
    "promise_delivered",
    "promise_shipped",
    "ship_from_store_success_rate",
    "vendor_bounce_rate",
]


@pytest.fixture(scope="module")
def hot(spark):
    """Tables where one order, release, line or card holds more than a third of the rows, partly as copies."""
    rows = random_rows(21, 60)
    pk = next(line["order_pk"] for line in rows["ord_order_line"] if line["delivery_method_id"] == "PickUpAtStore")
    releases = {r["pk"] for r in rows["ord_release"] if r["order_pk"] == pk}
    lines = {pk * 10 + n for n in range(4)}
    keys = {"order_pk": {pk}, "release_pk": releases, "order_line_pk": lines, "payment_method_pk": {1}}
    for name in (
        "ord_release_line",
        "ord_quantity_detail",
        "ord_fulfillment_detail",
        "ord_order_tracking_info",
        "pay_payment_transaction",
    ):
        found = [row for row in rows[name] if any(row.get(key) in values for key, values in keys.items())]
        copies = max(1, len(rows[name]) // max(1, len(found)))
        rows[name] += found * min(copies, 6)
    tables = spark_tables(spark, rows)
    for name in rows:
        tables[name].cache()
    return tables, duck_tables(rows)


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_keys_change_no_result(spark, hot, name):
    import oracle_queries

    tables, connection = hot
    result = spark_result(entry.operators()[name](spark, tables))
    assert result == duck_result(connection, oracle_queries.bodies()[name])


def test_a_hot_release_is_split_over_tasks(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 60000
        hot_or_own = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        lines = spark.range(0, n, 1, 16).select(
            hot_or_own.alias("release_pk"),
            F.lit("1").alias("order_line_id"),
            F.lit(1).alias("release_line_id"),
            F.concat(F.lit("item "), F.col("id")).alias("item_id"),
            F.lit(2.0).alias("quantity"),
            F.lit(1.0).alias("fulfilled_quantity"),
            F.lit(0.0).alias("cancelled_quantity"),
            F.lit(NOW).cast("timestamp_ntz").alias("created_timestamp"),
        )
        releases = spark.range(n).select(
            F.col("id").alias("pk"),
            F.col("id").alias("order_pk"),
            F.col("id").cast("string").alias("order_id"),
            F.lit("1").alias("release_id"),
            (F.col("id") % 2).alias("ship_from_location_id"),
            F.lit("Delivery").alias("destination_action"),
            F.lit("ShipToAddress").alias("delivery_method_id"),
            F.lit(NOW).cast("timestamp_ntz").alias("created_timestamp"),
        )
        places = [{"location_id": n, "location_sub_type_id": kind} for n, kind in enumerate(("StoreRegular", "3PL"))]
        small = spark_tables(spark, {"inv_location": places, "org_location": places})
        tables = small.replaced({"ord_release_line": lines, "ord_release": releases})
        rows = fill.unique_fill_rate(tables, entry.AS_OF, 30)
        total = {r.location_sub_type_id: r.fulfilled_quantity for r in rows.collect()}
        assert sum(total.values()) == n
        assert "skew=true" in plan_of(rows)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_are_only_sized_upwards(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 1) == int(before)
        assert size_shuffles(spark, 100 << 30) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder_is_under_the_checkpoint_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark), shared_folder(spark)
    assert first.startswith(root) and second.startswith(root) and first != second


def test_catalog_tables_and_their_columns(spark):
    rows = random_rows(5, 10)
    tables = spark_tables(spark, rows)
    names = {}
    for name in SCHEMAS:
        tables[name].createOrReplaceTempView(f"live_{name}")
        names[name] = f"live_{name}"
    live = catalog_tables(spark, names)
    assert live["ord_order"].count() == 10
    tables["ord_order"].drop("order_id").createOrReplaceTempView("live_ord_order")
    with pytest.raises(ValueError, match="ord_order lacks order_id"):
        catalog_tables(spark, names)["ord_order"]


LIVE_TYPES = {
    "timestamp_ntz": lambda c: c.cast("timestamp"),
    "double": lambda c: c.cast("decimal(18,2)"),
    "int": lambda c: c.cast("tinyint"),
}


@pytest.mark.parametrize(
    "name",
    [
        "allocation_funnel",
        "bopis_processing_time",
        "bopis_shorts",
        "cancel_rate",
        "open_orders_by_age",
        "promise_released",
        "return_to_shelf",
        "ship_from_store_success_rate",
        "stuck_in_allocated",
        "unique_fill_rate",
    ],
)
def test_types_of_a_live_database(spark, live, name):
    """Upper-case names, timestamps with zone, decimals, flags as booleans or numbers: the values are the same."""
    given, tables = live
    build = entry.operators()[name]

    def values(source):
        result = build(spark, source)
        plain = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in result.dtypes]
        return spark_result(result.select(*plain))

    assert values(tables) == values(given)


@pytest.fixture(scope="module")
def live(spark):
    given = spark_tables(spark, random_rows(31))

    def load(name):
        columns = []
        for column, kind in columns_of(name).items():
            value = LIVE_TYPES.get(kind, lambda c: c)(F.col(column))
            if column in ("is_confirmed", "is_cancelled", "is_return", "is_even_exchange"):
                value = F.col(column).cast("boolean")
            elif column == "is_on_hold":
                value = F.col(column).cast("tinyint")
            columns.append(value.alias(column.upper()))
        return given[name].select(*columns)

    names = {}
    for name in SCHEMAS:
        given[name].cache()
        load(name).createOrReplaceTempView(f"typed_{name}")
        names[name] = f"typed_{name}"
    return given, catalog_tables(spark, names)


def test_numeric_status_codes_become_text(spark):
    frame = spark.sql("select cast(3000 as decimal(10,3)) as status, 'x' as description, 'LPS' as profile_id")
    frame.createOrReplaceTempView("typed_status")
    statuses = catalog_tables(spark, {"fw_status_definition": "typed_status"})["fw_status_definition"]
    assert statuses.first().status == "3000.000"


def test_jdbc_options_split_the_scan():
    options = jdbc_options("jdbc:mysql://db/x", "ORD_ORDER", "PK", (1, 1000), 8, user="reader")
    assert options["partitionColumn"] == "PK" and options["numPartitions"] == "8" and options["user"] == "reader"
