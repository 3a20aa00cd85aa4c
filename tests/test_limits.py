"""What a task and the disk hold does not grow with the tables."""

import os

import pytest

import __spark_entry__ as entry
from ordergauge.llm import near_copies
from ordergauge.operators import promises
from ordergauge.plans import metrics, shared
from ordergauge.session import configure, shuffles_removed, stored_bytes
from ordergauge.sources.layout import write_tables
from ordergauge.sources.samples import BASE_TABLES
from ordergauge.sources.schemas import SCHEMAS
from ordergauge.sources.tables import parquet_tables
from tests.random_rows import random_rows
from tests.support import spark_result, spark_tables

SF_DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in found if name.startswith("shuffle_")}


def test_the_report_leaves_no_shuffle_files(spark):
    rows = random_rows(11, 60)
    tables = spark_tables(spark, rows)
    before = shuffle_files(spark)
    values = entry.operators()["metric_values"](spark, tables)
    got = spark_result(values)
    assert not shuffle_files(spark) - before
    assert got == spark_result(metrics.metric_values(tables, entry.SETTINGS))


@pytest.mark.parametrize("grain", [None, "month"])
def test_shared_joins_are_stored_in_passes(spark, tmp_path, monkeypatch, grain):
    """Large tables in several, each a share of the keys; the rows are those of the plain joins, and only they stay."""
    rows = random_rows(11, 60)
    rows["ord_order_line"] += [r | {"order_pk": None} for r in rows["ord_order_line"][:2]]
    rows["ord_release"] += [r | {"order_pk": None} for r in rows["ord_release"][:2]]
    rows["ord_release_line"] += rows["ord_release_line"][:9]
    write_tables(spark_tables(spark, rows), SCHEMAS, str(tmp_path / "tables"), grain=None)
    tables = parquet_tables(spark, str(tmp_path / "tables"))
    assert shared._passes(spark, tables) == 1
    monkeypatch.setattr(shared, "PASS_BYTES", 4096)
    assert 1 < shared._passes(spark, tables) <= shared.PASSES
    start = metrics.history_start(entry.SETTINGS)
    for since in (None, start):
        before = shuffle_files(spark)
        folder = tmp_path / f"joins {since}"
        found = shared.with_stored_facts(spark, tables, str(folder), grain, since)
        assert not shuffle_files(spark) - before
        assert sorted(os.listdir(folder)) == ["line_facts", "spine"]
        for name in ("line_facts", "spine"):
            plain = getattr(tables, name)
            if since:
                keep = shared._touched(plain, since)
                plain = plain.where(keep | shared._still_open(plain) if name == "spine" else keep)
            got = spark_result(getattr(found, name).select(*plain.columns))
            assert got[1] and got == spark_result(plain)


@pytest.mark.parametrize("name", ["promise_compliance", "promise_success_rate"])
def test_promises_are_counted_one_kind_at_a_time(spark, monkeypatch, name):
    """Each kind is stored and its shuffle files go before the next begins; as one plan the rows are the same."""
    tables = spark_tables(spark, random_rows(11, 60))
    before = shuffle_files(spark)
    found = entry.operators()[name](spark, tables)
    assert not shuffle_files(spark) - before
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = spark_result(found)
    monkeypatch.setattr(promises, "shared_folder", lambda spark: None)
    whole = entry.operators()[name](spark, tables)
    assert "Join" in whole._jdf.queryExecution().executedPlan().toString()
    assert got[1] and got == spark_result(whole)


def test_near_dedup_leaves_no_shuffle_files(spark):
    """Neither those of the stored steps nor those of the rounds of components, and the last step still runs twice."""
    words = [f"word{i}" for i in range(60)]
    texts = [*(" ".join([*words, f"end{i}"]) for i in range(6)), " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffle_files(spark)
    kept = near_copies.representatives(docs)
    assert not shuffle_files(spark) - before
    for _ in range(2):
        assert sorted(r.doc_id for r in kept.collect()) == [0, 6]


def test_the_setting_is_as_before(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_shuffle_partitions_follow_the_tables(spark, monkeypatch):
    paths = [f"{SF_DIR}/{name}.parquet" for name in BASE_TABLES]
    read = sum(map(os.path.getsize, paths))
    assert stored_bytes(spark, [*paths, f"{SF_DIR}/no_such_table.parquet"]) == read
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(entry, "SHUFFLE_SHARE", 4096)
    try:
        entry.queries()["fill_rate"](spark, SF_DIR)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-read // 4096) > int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_task_reads_a_bounded_share(spark, tmp_path):
    """A step that shuffles many times a task's share runs as many tasks, not as many as there are cores."""
    configure(spark)
    path = str(tmp_path / "large")
    spark.range(0, 9_000_000, 1, 2).selectExpr("xxhash64(id) as k", "id").write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        groups = spark.read.parquet(path).groupBy("k").count()
        assert groups.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
