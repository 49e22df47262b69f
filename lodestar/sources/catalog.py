"""Where the tables of a source are, and the tables that are written once: codes and grids."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a source's section.
KEYS = ("embeddings_directory", "npy_files_pattern", "chunk_dir", "metadata_path", "data_folder", "chunk_size_bytes", "combined_data_file")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def papers_of(spark: SparkSession, folder: str, stem: str, combined: str | None = None, schema: str | None = None) -> DataFrame:
    """The papers of a file: its own parquet, or the combined file of the source; no rows (of ``schema``) where there is neither."""
    for path in (f"{folder.rstrip('/')}/{stem}.parquet", combined):
        if path and exists(spark, path):
            return spark.read.parquet(path)
    return spark.createDataFrame([], schema or "source string, corpus_id long, title string, abstract string")


def config(spark: SparkSession, path: str) -> dict[str, dict]:
    """The sections of a configuration in JSON, or in YAML where a parser is installed; only known keys."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if PurePosixPath(path).suffix == ".json":
        sections = json.loads(text)
    else:
        import yaml

        sections = yaml.safe_load(text)
    return {name: {k: v for k, v in (section or {}).items() if k in KEYS} for name, section in sections.items()}


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows of an index by its metadata; 0 where there are none."""
    if not exists(spark, path):
        return 0
    meta = spark.read.schema("total_rows long").option("multiLine", True).json(path)
    return meta.agg(F.coalesce(F.max("total_rows"), F.lit(0))).first()[0]


def row_range(papers: DataFrame, start: int, rows: int, id_: str = "corpus_id") -> DataFrame:
    """The papers of a chunk: ``rows`` ids from ``start``. The bounds reach the scan, and files sorted by id are skipped by their statistics."""
    return papers.filter((F.col(id_) >= start) & (F.col(id_) < start + rows))


def write_codes(codes: DataFrame, path: str, mode: str = "append", by: str | None = None, sort: str = "id") -> None:
    """Codes are made once, at ingest, and appended; rows are sorted inside a file, so that ranges of ids are skipped. No rows write an empty table with its columns."""
    out = codes.sortWithinPartitions(sort) if sort in codes.columns else codes
    writer = out.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_grid(cells: DataFrame, path: str) -> None:
    """Grid cells and histograms, one small table for a map: the cells bound its rows."""
    cells.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_papers_by_key(papers: DataFrame, path: str, buckets: int, row_group_bytes: int = 8 << 20) -> DataFrame:
    """Papers bucketed and sorted by ``source, corpus_id``, with the abstract's length as a column of its own (``abstract_length``), and read back as a table: a join by that key needs no exchange on their side,
    filters on quality read no abstracts, and row groups are skipped by ranges of ids. The session knows the table by a name that nothing else uses; its files lie at ``path``."""
    name = f"papers_{uuid.uuid4().hex}"
    out = papers.withColumn("abstract_length", F.length("abstract"))
    writer = out.repartition(buckets, "source", "corpus_id").write.bucketBy(buckets, "source", "corpus_id").sortBy("source", "corpus_id").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer.option("path", path).saveAsTable(name)
    return papers.sparkSession.table(name)


def by_ids(papers: DataFrame, ids: list[tuple[str, int]]) -> DataFrame:
    """The papers of a bounded list of keys: the ids reach the scan, which skips row groups by them."""
    where = F.lit(False)
    for source in sorted({s for s, _ in ids}):
        where |= (F.col("source") == source) & F.col("corpus_id").isin(sorted(i for s, i in ids if s == source))
    return papers.filter(F.col("corpus_id").isin(sorted({i for _, i in ids})) & where)
