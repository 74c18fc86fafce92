"""The corpus pipeline: five stages from raw documents to token ids.

Every stage works on all that its predecessor kept. The first four return the columns of `documents`; the last one a
row per document with its ids. `run` writes what each stage returns to the shared folder, so a lost executor costs at
most a part of one stage, and no stage computes its predecessors again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, ngram_join, pieces, pseudonyms, quality
from tidemark.session import dealt, release, ship


def _begin(spark: SparkSession) -> None:
    """Before a stage: executors get the package, and the driver lets go of what the stages before it left."""
    ship(spark)
    release(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (a score under 0.5)."""
    _begin(spark)
    return quality.score(docs, quality.fitted(spark, docs, sf_dir), keep=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that n-gram similarity links, keeps the one with the smallest id (a null id comes last),
    once. Five words and a similarity of 0.8. Rows of one id with different texts are judged each by itself. Rows
    without words stay."""
    _begin(spark)
    p = F.xxhash64("text")
    several = common.written(docs.groupBy("doc_id").agg(F.min(p).alias("lo"), F.max(p).alias("hi")).where("doc_id IS NULL OR lo <> hi").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_own")), "several")
    rows = docs.withColumn("_node", F.col("doc_id"))
    plain = several.isEmpty()
    if not plain:  # their nodes are named by a hash of id and text, others by the id
        marked = docs.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        rows = marked.withColumn("_node", F.when(F.col("_own"), F.xxhash64(F.lit("node"), "doc_id", "text")).otherwise(F.col("doc_id"))).select(*docs.columns, "_node")
    found = ngram_join.join(rows.select("_node", "text"), id_col="_node", words=5, threshold=80).where("n_shingles > 0")
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("n")).withColumnRenamed("doc_id", "_node")
    found = common.written(found, "nodes")
    if plain:  # a component is named by its least id
        found = found.withColumn("kept", F.col("component"))
    else:  # the least id of each component and, of equal ones, the least node; texts don't move here
        ids = rows.select("_node", "doc_id").distinct().join(found, "_node")
        first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_node")).alias("f")).select("component", F.col("f._node").alias("kept"))
        found = found.join(first, "component")
    # Dealt at every size, so that what the texts take on disk grows with them and the driver gathers no table.
    kept = rows.join(dealt(found.where("_node <> kept").select("_node")), "_node", "left_anti")
    release(spark)
    again = common.written(found.where("_node = kept AND n > 1").select("_node"), "repeated")
    if not again.isEmpty():
        kept = kept.join(again, "_node", "left_anti").unionByName(kept.join(again, "_node", "left_semi").dropDuplicates(["_node"]))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    _begin(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms and counts the characters anew."""
    _begin(spark)
    named = pseudonyms.pseudonymise(docs)
    return named.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their count, checksum, and whether decoding gives the text back."""
    import public_tokenizers

    _begin(spark)
    return pieces.encode(docs, pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", token_stage),
]

#: Trained models and iterated components have no SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
