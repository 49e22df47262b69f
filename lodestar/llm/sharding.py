"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. A compaction groups runs of shards of about one size (a tier spans a factor
of four) into files of the target size and writes them anew. Each change writes a manifest and commits it as the next version: a pointer file is renamed into place, never over another one,
which a file system does whole or not at all, so of two writers one fails. Readers see the shards of one manifest; shards and manifests are never changed.
A run is bounded by the target, so the task that writes it is too.

Null and empty texts count 0 bytes; a text of any length stays whole, and a shard may pass the target by one arrival. An empty table has no shards. Repeated rows and null ids are kept.
Columns keep their names, also those that the store uses itself.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import free, written

#: Bytes of text in a full shard.
TARGET_BYTES = 128 << 20
#: Rows of an arriving shard at most.
ARRIVAL_ROWS = 2_000
#: Sizes within a tier differ by this factor at most.
TIER = 4.0
#: Shards of a lane of a tier: what one task packs into runs.
LANE_SHARDS = 50_000

MANIFEST = "shard string, path string, rows long, bytes long"


class ShardStore:
    """Shards under ``root``; the newest manifest says which of them count."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, text: str = "text"):
        self.spark, self.root, self.target, self.text = spark, root.rstrip("/"), target_bytes, text

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest version; 0 where nothing was committed."""
        fs, at = self._fs(f"{self.root}/manifests")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        fs, at = self._fs(f"{self.root}/manifests/v{version:08d}")
        stream = fs.open(at)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Commit a manifest as the version after ``after``; fails if another writer came first."""
        jvm, name = self.spark._jvm, f"m{uuid.uuid4().hex}"
        shards.select("shard", "path", "rows", "bytes").write.parquet(f"{self.root}/manifests/{name}")
        fs, fresh = self._fs(f"{self.root}/manifests/p{name}")
        out = fs.create(fresh, False)
        out.write(name.encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fresh, self._fs(f"{self.root}/manifests/v{after + 1:08d}")[1], never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(fresh, False)
            raise RuntimeError(f"version {after + 1} was committed by another writer") from e
        return after + 1

    def _listed(self, folder: str, schema) -> DataFrame:
        """The shards in a folder with their rows and bytes."""
        data = self.spark.read.schema(schema).parquet(folder)
        size = F.coalesce(F.octet_length(self.text), F.lit(0)).cast("long")
        path = data.metadataColumn("_metadata")["file_path"]
        return data.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).withColumn("shard", F.sha2("path", 256).substr(1, 16))

    def append(self, docs: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Write arrivals as small shards, tasks side by side, and commit."""
        before = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", arrival_rows).parquet(folder)
        return self.commit(self.manifest(before).unionByName(self._listed(folder, docs.schema)), before)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """``path, run``: shards to merge, by run, numbered from 0. Runs of a lane of a tier come in order of size and end at the target."""
        tier = F.floor(F.log(TIER, F.greatest(F.col("bytes"), F.lit(1)))).cast("int")
        lanes = max(1, -(-manifest.count() // LANE_SHARDS))
        small = manifest.filter(F.col("bytes") < self.target / 2).withColumn("tier", tier).withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)))
        upto = F.sum("bytes").over(Window.partitionBy("tier", "lane").orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parts = small.withColumn("part", F.floor((upto - F.col("bytes")) / self.target))
        runs = parts.groupBy("tier", "lane", "part").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
        runs = runs.withColumn("run", (F.row_number().over(Window.orderBy("tier", "lane", "part")) - 1).cast("int"))  # one row for each file to write
        return parts.join(runs, ["tier", "lane", "part"]).select("path", "run")

    def compact(self, schema) -> int:
        """Merge similar shards until none is left to merge; one version for each pass."""
        path, run = (free(c, schema.names) for c in ("path", "run"))
        while True:
            before = self.version()
            manifest = self.manifest(before)
            plan = written(self.plan(manifest), "merge-plan")
            runs = plan.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
            if not runs:
                return before
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            moved = self.read(schema, before, path).join(plan.select(F.col("path").alias(path), F.col("run").alias(run)), path).drop(path)
            moved.repartitionById(runs, run).write.option("compression", "zstd").partitionBy(run).parquet(folder)
            self.commit(manifest.join(plan, "path", "left_anti").unionByName(self._listed(folder, schema)), before)

    def read(self, schema, version: int | None = None, path: str = "shard_path") -> DataFrame:
        """The rows of a version, with the path of their shard. Folders are listed by Spark; rows of shards that the manifest doesn't name are left out."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], schema).withColumn(path, F.lit(None).cast("string"))
        named = self.manifest(version)
        folders = [r[0] for r in named.select(F.regexp_extract("path", r"^(.*/data/[0-9a-f]{32})/", 1)).distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(path, F.lit(None).cast("string"))
        parts = None
        for folder in folders:
            part = self.spark.read.schema(schema).parquet(folder)
            part = part.select(*(F.col(f"`{c}`") for c in schema.names), part.metadataColumn("_metadata")["file_path"].alias(path))
            parts = part if parts is None else parts.unionByName(part)
        return parts.join(named.select(F.col("path").alias(path)), path, "left_semi")


def sharded(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Append ``docs`` to the store at ``root``, compact it, and tell where each document is: ``doc_id, shard, shard_rows, shard_bytes, version``."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/lodestar/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs, arrival_rows)
    version = store.compact(docs.schema)
    path = free("path", docs.columns)
    shards = store.manifest(version).select(F.col("path").alias("at"), F.struct("shard", "rows", "bytes").alias("its"))
    rows = store.read(docs.schema, version, path).select("doc_id", F.col(path).alias("at")).join(shards, "at")
    return rows.select("doc_id", "its.shard", F.col("its.rows").alias("shard_rows"), F.col("its.bytes").alias("shard_bytes"), F.lit(version).alias("version"))
