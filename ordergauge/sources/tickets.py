"""Exported pages of a ticket service as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = "struct<name:string>"
PAGE_SCHEMA = (
    "startAt bigint, total bigint, issues array<struct<key:string, fields:struct<"
    f"created:string, updated:string, project:{_NAMED}, priority:{_NAMED}, components:array<{_NAMED}>, "
    "status:struct<statusCategory:struct<name:string>>>>>"
)
BROKEN = "broken_page"
#: pages of an export that ``write_ticket_pages`` fills
PAGE_SIZE = 100


def _pages(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(f"{PAGE_SCHEMA}, {BROKEN} string")
    return reader.json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)


def _is_broken():
    return F.col(BROKEN).isNotNull() | F.col("issues").isNull()


def broken_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page): the pages that are no whole JSON document of the expected form, with their text if it has one."""
    return _pages(spark, path).where(_is_broken()).select(F.input_file_name().alias("file"), F.col(BROKEN).alias("page"))


def read_ticket_pages(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """All tickets of the JSON pages under ``path``: one row per ticket and component of its latest state.

    A ticket that moved between pages during the export, or is in several exports, may be there in several states: the one
    updated last counts, and where pages do not say when, the one further on in the export (``startAt``); of states that
    agree in both the greatest by project, priority, status and creation. Names are compared in lower case by the ticket
    service; priority and component come in lower case here.

    A page that was cut off or is something else (a broken one) gives no tickets. With ``quarantine``, a folder that
    does not exist yet, such pages are stored there; ``broken_pages`` lists them.
    """
    if quarantine:
        broken_pages(spark, path).write.parquet(quarantine)
    issues = _pages(spark, path).where(~_is_broken()).select("startAt", F.inline("issues"))
    state = F.struct(
        F.col("fields.project.name").alias("project"),
        F.lower("fields.priority.name").alias("priority"),
        F.col("fields.status.statusCategory.name").alias("status_category"),
        F.to_timestamp("fields.created").cast("timestamp_ntz").alias("created"),
        F.array_sort(F.transform("fields.components", lambda c: F.lower(c["name"]))).alias("components"),
    )
    # nulls come first, so any time counts as later than none
    latest = F.max(F.struct(F.to_timestamp("fields.updated").alias("updated"), "startAt", state.alias("state")))
    found = issues.groupBy(F.col("key").alias("ticket_key")).agg(latest.alias("latest"))
    return found.select("ticket_key", "latest.state.*").select(
        "ticket_key",
        F.explode_outer(F.array_distinct("components")).alias("component"),
        "project",
        "priority",
        "status_category",
        "created",
    )


def ticket_pages(tickets: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """(page, text): the pages of an export of tickets (ticket_key, project, priority, component, status_category, created, updated).

    Tickets go by key; ``size`` keys in a row, by the ranges of their hash, make a page of about that many.
    """
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000"))
    fields = F.struct(
        stamp("created").alias("created"),
        stamp("updated").alias("updated"),
        named("project").alias("project"),
        named("priority").alias("priority"),
        F.array_compact(F.array(named("component"))).alias("components"),
        F.struct(named("status_category").alias("statusCategory")).alias("status"),
    )
    pages = -(-tickets.count() // size) or 1
    dealt = tickets.select(
        F.pmod(F.xxhash64("ticket_key", "updated"), F.lit(pages)).alias("page"),
        F.struct(F.col("ticket_key").alias("key"), fields.alias("fields")).alias("issue"),
    )
    whole = dealt.groupBy("page").agg(F.sort_array(F.collect_list("issue")).alias("issues"))
    text = F.to_json(F.struct((F.col("page") * size).alias("startAt"), F.size("issues").alias("total"), "issues"))
    return whole.select("page", text.alias("text"))


def write_ticket_pages(pages: DataFrame, path: str) -> None:
    """Write the pages (page, text), one file for each."""
    pages.select("text").write.option("maxRecordsPerFile", 1).text(path)
