"""License scans by diagonal voting.

A template is a phrase or notice that names a license. Every run of ``GRAM`` words of a text is hashed and joined with
the runs of the templates; a hit at text word i and template word j votes for the diagonal i - j. Runs of one occurrence
vote for one diagonal, an insertion or a deletion only moves it a little, so neighbouring diagonals merge into a span,
and a span is accepted by how much of the template its verified words cover. Licenses of one family differ in little but
their version, so of a template that names one, the run that holds it must be among the verified ones. A hit is verified
by comparing the words themselves, so a collision of hashes votes for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

#: words in a run; no template may be shorter
GRAM = 3
#: a word, in a text with A-Z in lower case
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: how far two diagonals of one occurrence may be apart
SLACK = 2
#: runs of all templates up to which their table is broadcast
BROADCAST_RUNS = 100_000


@dataclass(frozen=True)
class Template:
    """``coverage``: the part of the template's runs that a span needs; a base template needs all, on one diagonal.

    ``versioned``: the phrase ends in the license's version, and a span needs its last run whatever else it covers.
    """

    label: str
    phrase: str
    base: bool = False
    coverage: float = 0.6
    versioned: bool = False


#: The phrases that are counted.
BASE_TEMPLATES = (
    Template("mit", "under the mit license", True, 1.0),
    Template("apache-2", "apache license version 2", True, 1.0),
    Template("cc-by-nc", "cc by nc", True, 1.0),
)
#: Grant notices as the licenses give them, in lower case without punctuation.
OWN_TEMPLATES = (
    Template("agpl-3", "licensed under the gnu affero general public license version 3", coverage=0.8, versioned=True),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    Template("cc-by", "licensed under cc by 4 0", coverage=1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", coverage=1.0),
    Template("gpl-2", "licensed under the gnu general public license version 2", coverage=0.8, versioned=True),
    Template("gpl-3", "licensed under the gnu general public license version 3", coverage=0.8, versioned=True),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", coverage=0.8, versioned=True),
    Template("mit", "released under the mit license", coverage=1.0),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        coverage=0.8,
        versioned=True,
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = BASE_TEMPLATES + OWN_TEMPLATES


def _run_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(GRAM)))


def template_runs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, coverage, runs, word, run, needed, hash): one row for each run of each template."""
    if short := [t.phrase for t in templates if len(t.phrase.split()) < GRAM]:
        raise ValueError(f"templates of fewer than {GRAM} words: {short}")
    rows = []
    for number, t in enumerate(templates):
        words = t.phrase.split()
        runs = len(words) - GRAM + 1
        every = [at == runs - 1 or not t.versioned for at in range(runs)]
        rows += [(number, t.label, t.base, t.coverage, runs, at, words[at : at + GRAM], every[at]) for at in range(runs)]
    kinds = "template int, label string, base boolean, coverage double, runs int, word int, run array<string>, needed boolean"
    table = spark.createDataFrame(rows, kinds).withColumn("hash", _run_hash(F.col("run"), F.lit(0)))
    return F.broadcast(table) if len(rows) <= BROADCAST_RUNS else table


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(WORD), F.lit(0))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Accepted spans of (doc_id, text_key, text): (doc_id, text_key, label, base, start, stop, likeness).

    ``start`` and ``stop`` count words, ``likeness`` is the part of the template's runs that the span has. Overlapping
    occurrences are spans of their own. Rows that agree in id and text give each span once.
    """
    words = docs.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    last = F.size("words") - GRAM
    # outer, for a filter on empty arrays would be pushed down with the whole expression in it
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _run_hash(F.col("words"), i)))
    exploded = words.withColumn("hashes", hashes).select("doc_id", "text_key", "words", F.posexplode_outer("hashes").alias("at", "hash"))
    # as bounds, for equalities would become keys of the join, and each run of a text would be put together as one
    verified = F.lit(True)
    for k in range(GRAM):
        own, wanted = F.get("words", F.col("at") + k), F.get("run", F.lit(k))
        verified = verified & (own >= wanted) & (own <= wanted)
    hits = exploded.join(template_runs(docs.sparkSession, templates), "hash").where(verified)
    document = ["doc_id", "text_key"]
    template = ["template", "label", "base", "coverage", "runs"]
    votes = hits.groupBy(*document, *template, (F.col("at") - F.col("word")).alias("diagonal")).agg(
        F.collect_set("word").alias("votes"),
        F.max("needed").alias("needed"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    # a base template stands where one diagonal has all its runs; others gather the votes of neighbours
    along = Window.partitionBy(*document, "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1).over(along) > SLACK)
    votes = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(along))
    merged = votes.groupBy(*document, *template, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("covered"),
        F.max("needed").alias("needed"),
        F.min("first").alias("start"),
        (F.max("last") + GRAM).alias("stop"),
    )
    likeness = F.col("covered") / F.col("runs")
    return merged.where(F.col("needed") & (likeness >= F.col("coverage"))).select(
        *document, "label", "base", F.col("start").cast("long"), F.col("stop").cast("long"), likeness.alias("likeness")
    )


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base templates, ``first_word`` and ``last_word`` are the least and largest of their
    starts (null without any). ``base_labels`` and ``labels`` are sorted, distinct and joined by commas, empty without
    any. ``score`` is the largest likeness of an accepted span, 0 without one. Null and empty texts have no words.
    Repeated rows, and a null id, give a row each; they are told apart by id and text together. Columns other than id
    and text are not looked at; an empty table gives an empty one.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(whole_text(F.col(text)).cast("binary")).alias("text_key")
    )
    found = spans(keyed, templates)
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    base = F.col("base")
    by_document = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("likeness").alias("score"),
    )
    counted = keyed.select(
        "doc_id",
        "text_key",
        F.regexp_count(ascii_lower(whole_text(F.col("text"))), F.lit(WORD)).cast("long").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    return counted.join(by_document, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
