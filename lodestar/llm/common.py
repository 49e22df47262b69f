"""What the operators share: written tables, words and batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Characters that separate words: the space and the ASCII controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch when rows hold whole texts.
BATCH_ROWS = 256


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lodestar/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores after it as long as a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one row may be a text of many megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(text: str | Column) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, " ")


def text_key(text: str = "text") -> Column:
    """A name of 16 bytes for the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def word_array(text: str | Column) -> Column:
    """Words of the text, in order; none for an empty or null one."""
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def slot(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bit_filter(wanted: DataFrame, column: str, bits: int, hashed: bool = False) -> np.ndarray:
    """``bits`` bits in words of 64: those of the slots of the wanted values (or hashes) are set. The driver holds no more than these."""
    at = wanted.select((F.pmod(F.col(column), F.lit(bits)) if hashed else slot(column, bits)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    table = np.zeros(bits // 64, np.int64)
    for r in at.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("mask")).collect():
        table[r.word] = r.mask
    return table.view(np.uint64)


def in_filter(table: np.ndarray, slots: pa.Array) -> pa.Array:
    at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)
