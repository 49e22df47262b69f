"""Tables that a job writes into the shared folder and deletes when they are of no more use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A folder of a job's own. A table is written and read back, so lineage ends there and a lost executor costs no more than its tasks; the next version of a table takes its place."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.versions = spark, f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before, path = self.versions.get(name), f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.versions[name] = path
        if before:
            delete(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, name: str) -> None:
        """Deletes all tables but this one."""
        for other in [n for n in self.versions if n != name]:
            delete(self.spark, self.versions.pop(other))

    def clear(self) -> None:
        """Deletes the folder."""
        self.versions.clear()
        delete(self.spark, self.root)


def groups(batches: Iterator[pa.RecordBatch], keys: int, at_least: int = 1 << 14) -> Iterator[pa.Table]:
    """Rows that are sorted by their first ``keys`` columns (longs), as tables that hold whole groups: a group that goes on in the next batch waits for it. Tables have about ``at_least`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < at_least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = np.column_stack([rows.column(i).to_numpy() for i in range(keys)])
        end = int(np.argmax((key == key[-1]).all(axis=1)))
        if end:
            yield rows.slice(0, end)
        held = rows.slice(end).to_batches()
        size = rows.num_rows - end
        at_least = max(at_least, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
