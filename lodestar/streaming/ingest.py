"""Structured Streaming forms of incremental ingest and of session counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema, key: str | Column, target: str, checkpoint: str, fmt: str = "parquet") -> int:
    """Append to ``target`` the rows of new files whose key was never seen, and return how many rows came in.

    Files and keys are remembered in the checkpoint, so a run picks up where the last one ended. State grows with the keys: it holds one entry for each (``known.ingest_known`` keeps them in a table instead).
    """
    rows = spark.readStream.format(fmt).schema(schema).load(source)
    keyed = rows.withColumn("_key", F.col(key) if isinstance(key, str) else key).dropDuplicates(["_key"]).drop("_key")
    query = keyed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def ingest_anti_join(spark: SparkSession, source: str, schema, key: str, target: str, checkpoint: str, fmt: str = "parquet") -> int:
    """The same with a batch anti-join against ``target``: no state beside the table itself, all of whose keys each batch reads.

    A batch that is repeated after a failure between its append and its commit adds rows without a key again; ``known.ingest_known`` has neither limit.
    """
    from ..operators.index import new_rows

    def append(batch: DataFrame, _: int) -> None:
        try:
            existing = spark.read.schema(schema).parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = spark.createDataFrame([], batch.schema)
        new_rows(batch, existing, key, within_batch=True).write.mode("append").parquet(target)

    rows = spark.readStream.format(fmt).schema(schema).load(source)
    query = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``; works on a stream, where the watermark bounds the state."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
