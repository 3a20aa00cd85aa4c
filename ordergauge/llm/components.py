"""Connected components of a table of links, without taking links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _towards_least(links: DataFrame) -> DataFrame:
    """(u, v, least of u and its partners) for each link from u to v."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return links.join(least, "u")


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    smaller = _towards_least(larger)
    return (
        smaller.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(smaller.select("u", F.col("least").alias("v")))
        .where("u > v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(u, v) with v the least node that u can reach, for every node u with a link except the least ones themselves.

    ``links`` has two long columns ``u`` and ``v`` in any direction, repeated or not; loops and nulls are no links. An
    empty table gives an empty one. Alternating star steps shorten all paths at once, so the rounds grow with the
    logarithm of a component's size. Each round is one checkpoint; only a count and a checksum come to the driver.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        links = checkpointed(links)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return links
        before, links = now, _round(links)
