"""A training-data pipeline over ``documents``: rules, lines, near copies, leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each stage's result and reads it back for the next. A stage
may also be called alone, so each applies the session settings itself. Tables an operator lands on its
way are removed once the stage's own small table is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import bpe, leaks, lines, near, rules
from fleetlens.llm.common import land, land_last, small
from fleetlens.session import tune

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, as they are. Rows that repeat an id are judged each by its own text."""
    tune(spark)
    rejected = land_last(lambda: rules.judge(docs).filter("not kept").select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), spark, "pipeline-rejected")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_hash"))
    return docs.join(small(rejected), own, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of every group of lines stays; documents with no line left go."""
    tune(spark)
    return lines.without_lines(docs, land_last(lambda: lines.line_decisions(docs), spark, "pipeline-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group stays, once if its row is repeated.

    Different texts under one id are documents of their own, named by a number
    above all ids. Documents without an id cannot be named and stay.
    """
    tune(spark)
    own = F.xxhash64("text")
    repeated = land(docs.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n"), (F.min(own) != F.max(own)).alias("_differ")).filter(
        "n > 1 and _again is not null").drop("n"), "pipeline-repeated")
    named = docs.withColumn("_name", F.col("doc_id").cast("long"))
    if not repeated.isEmpty():
        again = small(repeated)
        above = F.lit(1 << 62).bitwiseOR(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)))
        once = docs.join(again, docs["doc_id"] == F.col("_again")).dropDuplicates(["doc_id", "text"])
        named = named.join(again, docs["doc_id"] == F.col("_again"), "left_anti").unionByName(
            once.withColumn("_name", F.when(F.col("_differ"), above).otherwise(F.col("doc_id").cast("long"))).drop("_again", "_differ"))
    copies = land_last(lambda: near.near_copies(named.select(F.col("_name").alias("doc_id"), "text")).filter("class_id <> doc_id").select(
        F.col("doc_id").alias("_copy")), spark, "pipeline-copies")
    return named.join(small(copies), F.col("_name") == F.col("_copy"), "left_anti").drop("_name")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; those without an id stay. Texts under one id are judged each by itself."""
    tune(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    name = F.xxhash64(F.col("doc_id"), F.col("text"))
    leaked = land_last(lambda: leaks.leaked_passages(docs.filter("doc_id is not null").select(name.alias("doc_id"), "text"), benchmark).select(
        F.col("doc_id").alias("_leaked")).distinct(), spark, "pipeline-leaks")
    return docs.join(small(leaked), docs["doc_id"].isNotNull() & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_leaked")), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, round_trip): token ids as little-endian 32-bit integers, checked by decoding them."""
    tune(spark)
    path = public_tokenizers.path(VOCABULARY)
    # Written in between, so that no task runs an encoder and a decoder side by side.
    encoded = land(bpe.encode(docs, path, bpe.build_lexicon(docs, path)), "pipeline-encoded")
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

# Fuzzy lines, near copies and merges are not expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
