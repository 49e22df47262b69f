"""A training-data pipeline over ``documents``: each stage calls one operator on what the one before it kept.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Tables beside the documents (``labels``, ``benchmark``) are read from ``sf_dir``.
Rows are judged and dropped by id and text, so a row without an id, or with the id of another, shares the fate of its own text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_row, text_key, written
from lodestar.llm.decontamination import decontamination
from lodestar.llm.mixing import mixed
from lodestar.llm.ngram_join import ngram_rows
from lodestar.llm.sharding import sharded
from lodestar.llm.toxicity import toxicity

#: The SQL of run(): stages 1 and 3 score and canonicalise in ways that SQL can't express.
ORACLE_SQL = None


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``row, id, key`` of ``docs``, joined to ``rows`` (``doc_id, key``) of the same id and text."""
    rows = rows.select(F.col("doc_id").alias("that_id"), F.col("key").alias("that_key")).distinct()
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    return named.join(rows, F.col("id").eqNullSafe(F.col("that_id")) & (F.col("key") == F.col("that_key")), how)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _matched(docs, rows, "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=text_key())
    return _without(docs, scores.filter("predicted = 1"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays; of those without an id, or with the same, one. Texts without words are no copies."""
    rows = written(ngram_rows(docs, size=5, percent=80, key=text_key()).filter("n > 0").select("doc_id", "key", "component"), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = rows.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    # Written before the join, so that rows of a large group are dealt to several tasks.
    told = rows.join(written(groups, "groups"), "component").withColumn("first", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    # Rows of one id and text can't be told apart: one of them is taken.
    repeated = told.filter("first").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    ones = _matched(docs, repeated, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return _without(docs, told.filter("not first").select("doc_id", "key").unionByName(repeated.select("doc_id", "key"))).unionByName(ones)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=text_key())
    return _without(docs, found.filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
