"""Mixing sources to target weights by pivotal dependent rounding.

Each document should be copied (target of its source) / (size of its source) times, a fraction. The whole part is sure;
the rest is a probability, and pairs of documents settle theirs: words move at random from one to the other, neither
way favoured, until one of the two probabilities is 0 or 1. Every pair keeps its expected words, so a source's total
stays at its target all along, and what is left in the end is the rounding of one document.

The pairs form a tree. Documents of a source and a size class are dealt to groups of bounded size; a group settles all
but one document; the residuals form groups again. One group of each class sits out: at the root of a source it meets
the residuals, largest documents first, so that the last one to be rounded is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, word_count

#: documents in a group of the tree, on average
GROUP = 64
SURE = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh as ``weights`` says, over and over. They share the sum of all sizes; a
    target above ``most`` times its source's size stops there, and the excess goes to the others by weight, until none
    is above. The sources are numbered in one task, one short row for each.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights)).cast("int"))
    sources = checkpointed(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # words for each unit of weight, once all sources that are over at the last level stop at their caps
        over = F.col("cap") < F.col("weight") * level
        stopped, weighing = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        after = (total - (stopped or 0.0)) / weighing if weighing else level
        if after <= level:
            break
        level = after
    return sources.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _settle(a: Column, b: Column, seed: int) -> Column:
    """Two documents (struct with size and p) after moving words between them until one p is 0 or 1."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["tie"], b["tie"], a["size"], b["size"]), 11) / float(1 << 53)
    limits = F.struct(
        ((1 - a["p"]) * a["size"]).alias("fill_a"),
        (b["p"] * b["size"]).alias("drain_b"),
        (a["p"] * a["size"]).alias("drain_a"),
        ((1 - b["p"]) * b["size"]).alias("fill_b"),
    )

    def move(x: Column) -> Column:
        up, down = F.least(x["fill_a"], x["drain_b"]), F.least(x["drain_a"], x["fill_b"])
        return let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(
            chance * (m["up"] + m["down"]) < m["down"], m["up"]
        ).otherwise(-m["down"]))

    def near(p: Column) -> Column:
        return F.when(p < SURE, 0.0).when(p > 1 - SURE, 1.0).otherwise(p)

    return let(
        let(limits, move),
        lambda words: F.array(
            a.withField("p", near(a["p"] + words / a["size"])), b.withField("p", near(b["p"] - words / b["size"]))
        ),
    )


def _fold(documents: Column, seed: int) -> Column:
    """The documents of a group with all but at most one of their p settled: pairs in turn, largest first."""
    element = "struct<order:bigint,tie:bigint,doc_id:bigint,size:bigint,base:int,p:double>"
    start = F.struct(
        F.lit(None).cast(element).alias("open"), F.array().cast(f"array<{element}>").alias("done")
    )

    def add(state: Column, x: Column) -> Column:
        pair = F.when(state["open"].isNull(), F.array(x)).otherwise(_settle(state["open"], x, seed))
        is_open = lambda d: (d["p"] > 0) & (d["p"] < 1)
        return let(
            pair,
            lambda both: F.struct(
                F.get(F.filter(both, is_open), F.lit(0)).alias("open"),
                F.concat(state["done"], F.filter(both, lambda d: ~is_open(d))).alias("done"),
            ),
        )

    return F.aggregate(
        F.array_sort(documents),
        start,
        add,
        lambda s: F.concat(s["done"], F.filter(F.array(s["open"]), lambda d: d.isNotNull())),
    )


def _level(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The rows after each group of equal keys has settled all but one."""
    document = F.struct(F.col("order"), "tie", "doc_id", "size", "base", "p")
    grouped = rows.groupBy(*keys).agg(_fold(F.collect_list(document), seed).alias("documents"))
    return grouped.select(*keys, F.explode("documents").alias("d")).select(*keys, "d.*")


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 29,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    ``size`` is the number of words; null and empty texts have none, and whole copies only. Repeated rows are documents
    of their own and may get different numbers; which of two identical rows gets which does not matter. A null source is
    a source of its own, a null id is an id like any other. Reruns on the same rows agree. An empty table gives an
    empty one; a source without words has target 0 and no copies. ``most`` bounds a document's copies.
    """
    rows = checkpointed(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    )
    targets = checkpointed(source_targets(rows, weights, most))
    keyed = targets.select(F.col("source").alias("__source"), "source_size", "target")
    rows = rows.join(keyed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = rows.select(
        "*",
        (-F.col("size")).alias("order"),
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("tie"),
        F.floor(wanted + SURE).cast("int").alias("base"),
        F.greatest(wanted - F.floor(wanted + SURE), F.lit(0.0)).alias("p"),
        F.floor(2 * F.log2(F.col("size") + F.lit(1))).cast("int").alias("class"),
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "base", "p"]
    of_source = ["source", "source_size", "target"]
    sure = (F.col("p") < SURE) | (F.col("size") == 0)
    settled = [rows.where(sure).withColumn("p", F.lit(0.0)).select(*columns)]

    rows = rows.where(~sure)
    classes = checkpointed(
        rows.groupBy("source", "class").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups"))
    )
    sized = classes.select(F.col("source").alias("__source"), F.col("class").alias("__class"), "groups")
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("class") == F.col("__class"))
    rows = rows.join(sized, same).withColumn("group", F.pmod(F.xxhash64("tie", F.lit(1)), "groups"))
    keys = [*of_source, "class", "group"]
    plain = ["order", "tie", "doc_id", "size", "base", "p"]

    groups = classes.agg(F.max("groups")).first()[0] or 0
    waiting = rows.where("group = 0").select(*keys, *plain)
    going = rows.where("group > 0").select(*keys, *plain)
    while groups > 1:
        level = checkpointed(_level(going, keys, seed))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(level.where(~is_open).select(*columns))
        going = level.where(is_open).withColumn("group", F.expr(f"`group` div {GROUP}"))
        groups = -(-groups // GROUP) if groups > GROUP else 1
    root = _level(waiting.unionByName(going), of_source, seed)
    settled.append(root.select(*columns))

    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    rounded = F.col("base") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
    return whole.select(*columns[:-2], rounded.cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 29) -> DataFrame:
    """The documents of the mix: each row as often as it is copied, columns unchanged.

    Copies belong to (doc_id, source, size); rows that agree in all three are numbered, so that each gets its own.
    """
    names = docs.columns
    number = copies(docs, weights, most, seed)
    alike = Window.partitionBy("doc_id", "source", "size").orderBy("copies")
    number = number.select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        F.col("size").alias("__words"),
        "copies",
        F.row_number().over(alike).alias("__number"),
    ).withColumnRenamed("copies", "__copies")
    own = docs.withColumn("__size", word_count(F.col("text")))
    own = own.withColumn("__at", F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy("text")))
    match = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__size") == F.col("__words"))
        & (F.col("__at") == F.col("__number"))
    )
    chosen = own.join(number.where("__copies > 0"), match)
    return chosen.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*names)
