"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decision_list,
    fingerprints,
    hard_negatives,
    license_scan,
    line_dedup,
    lm_scoring,
    merkle_manifest,
    mixing,
    oracle,
    secret_scan,
    sentencepiece_codec,
    sharding,
    simhash_pivots,
    token_counts,
)
from .common import with_package

#: the public SentencePiece vocabulary of this machine; a parameter of the operators
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: its end-of-sentence piece, which no text encodes to
SEPARATOR = 2
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, a hash of the ids, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL)
    text = F.coalesce("text", F.lit(""))
    return back.select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.replace(text, F.lit(sentencepiece_codec.MARK), F.lit(" "))).alias("round_trip"),
    )


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)
    base = [r.kind for r in secret_scan.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *map(number, base), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleaved_shards(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash_pivots.hex_digits(F.col("fingerprint")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    names = ["doc_id", *decision_list.COUNTS, "base_failed", "kept", "failed_rule"]
    return decision_list.judged(docs, rules).select(*names)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, by writing the documents' tokens to flat files and scanning those for separators."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_codec.encode(docs, MODEL)
    blocks = token_counts.stored(token_counts.token_blocks(encoded, SEPARATOR))
    return token_counts.separator_scan(blocks, SEPARATOR).select("doc_id", "n_tokens", "file", "place", "start")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(table(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def relabelled() -> Column:
    """The labels that hard negatives are mined with: some are changed first."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def hard_negatives_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabelled=relabelled())


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.scores(table(spark, sf_dir, "documents"), held_out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses,
        "op2_sentencepiece": sentencepiece,
        "op3_secret_scan": secrets,
        "op4_sharding": shards,
        "op5_simhash_near_dedup": near_duplicates,
        "op6_line_dedup": lines,
        "op7_quality_rules": quality,
        "op8_fingerprints": document_fingerprints,
        "op9_token_counts": tokens,
        "op10_mixing": mixture,
        "op11_hard_negatives": hard_negatives_of,
        "op12_merkle_manifest": manifest,
        "op13_lm_scoring": language_model,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; tests hold the others against brute force."""
    return oracle.texts()
