"""Ingest that remembers its keys in a table instead of the stream's state.

Known keys lie in folders by bucket, with a fixed bit filter for each bucket and batch. A batch looks at the filters of its own buckets only: what they reject is new for certain, and only for what they pass are the keys of those buckets read, to be compared. Keys of more than ``SHORT`` bytes, such as whole texts, are stored and compared by their SHA-256, so a key is never larger than its digest; shorter ones as they are.
So a batch reads in proportion to its own rows, and nothing is kept in memory between batches. Rows, keys and filters of a batch are written under its number and count from the commit of one version that names them: a batch that is repeated after a failure, rows without a key included, is written once.

Batches are merged by size, so their number stays near the logarithm of the table's; and when buckets outgrow ``bucket_keys``, the table is dealt out anew to four times as many.
Of rows with one key in a batch the one with the smallest hashes of all its columns stays; rows without a key all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import groups
from ..sources.versions import Versions

#: Keys of a bucket; bits of a filter for each key, and how many of them a key sets.
BUCKET_KEYS, BITS, SET = 50_000, 12, 6
#: Keys up to this many bytes are stored as they are.
SHORT = 64
#: Of batches of less than twice the next larger one's keys this many are merged.
MERGED = 4


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash, by two halves of it."""
    first, second = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) % np.uint64(size) for i in range(SET)])


def _filter(hashes: np.ndarray) -> bytes:
    size = max(64, -(-len(hashes) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, 1):
        bucket, hashes = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[a])], "bits": pa.array([_filter(hashes[a:b])], pa.binary())})


def _passed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of a bucket that one of its filters passes."""
    hashes = left.column("hash").to_numpy().view(np.uint64)
    hit = np.zeros(len(hashes), bool)
    for raw in right.column("bits").to_pylist():
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        hit |= bits[_places(hashes, len(bits))].astype(bool).all(axis=0)
    return left.filter(pa.array(hit))


class KnownKeys:
    """The table of rows and of their keys under ``root``. ``key`` is an expression over a row, text or anything that can be cast to it."""

    def __init__(self, spark: SparkSession, root: str, key: str, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.key, self.bucket_keys, self.versions = spark, key, bucket_keys, Versions(spark, root)

    def _read(self, what: str, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.versions.root}/{what}/run={n}" for n in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.versions.root}/{what}").parquet(*paths).drop("run") if paths else self.spark.createDataFrame([], schema)

    def rows(self, schema) -> DataFrame:
        """What was ingested so far."""
        names = self.versions.latest()[1].get("rows", [])
        paths = [f"{self.versions.root}/rows/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _keyed(self, rows: DataFrame, buckets: int) -> DataFrame:
        whole: Column = F.expr(self.key).cast("string")
        # A mark tells short keys from digests.
        key = F.when(F.octet_length(whole) <= SHORT, F.concat(F.lit("="), whole)).otherwise(F.sha2(whole, 256))
        return rows.select(F.struct("*").alias("row"), key.alias("key")).withColumn("hash", F.xxhash64("key")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(buckets)))

    def new(self, batch: DataFrame, content: dict) -> DataFrame:
        """``row, key, hash, bucket`` of what isn't known, one row for each key, and all rows without one."""
        buckets = content.get("buckets", 1)
        keyed = self._keyed(batch, buckets)
        # Two hashes with seeds of their own: rows that agree in both are equal. A row goes over one shuffle, its place among those of its key by 16 bytes.
        order = Window.partitionBy("key").orderBy(F.xxhash64("row"), F.xxhash64(F.lit(1), "row"))
        once = keyed.filter("key is not null").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
        if content.get("keys"):
            names = keyed.filter("key is not null").select("bucket", "hash", "key")
            touched = sorted(r[0] for r in names.select("bucket").distinct().collect())  # no more than there are buckets
            filters = self._read("filters", [k["name"] for k in content["keys"]], "bits binary, bucket long").filter(F.col("bucket").isin(touched))
            asked = names.distinct()
            maybe = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_passed, "bucket long, hash long, key string")
            near = sorted(r[0] for r in maybe.select("bucket").distinct().collect())
            stored = self._read("keys", [k["name"] for k in content["keys"]], "key string, hash long, bucket long").filter(F.col("bucket").isin(near))
            seen = maybe.join(stored, ["bucket", "hash", "key"], "left_semi")
            once = once.join(seen.select("key"), "key", "left_anti").select("row", "key", "hash", "bucket")
        return once.unionByName(keyed.filter("key is null"))

    def _write_keys(self, keys: DataFrame, name: str) -> None:
        """``key, hash, bucket`` as a batch of keys and filters; a name that is written again is replaced."""
        keys.repartition("bucket").sortWithinPartitions("bucket", "hash").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.versions.root}/keys/run={name}")
        stored = self._read("keys", [name], "key string, hash long, bucket long")
        stored.select("bucket", "hash").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_filters, "bucket long, bits binary").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.versions.root}/filters/run={name}")

    def ingest(self, batch: DataFrame, number: int) -> int:
        """Adds a batch and returns how many rows of it were new. A number that was committed before adds nothing."""
        base, content = self.versions.latest()
        if number <= content.get("last", -1):
            return 0
        name = f"{number:012d}"
        new = self.new(batch, content)
        new.select("row.*").write.mode("overwrite").parquet(f"{self.versions.root}/rows/{name}")
        added = self.spark.read.schema(batch.schema).parquet(f"{self.versions.root}/rows/{name}")
        buckets = content.get("buckets", 1)
        keys = self._keyed(added, buckets).filter("key is not null").select("key", "hash", "bucket")
        count, fresh = added.count(), keys.count()
        out = {"last": number, "buckets": buckets, "rows": content.get("rows", []) + [name] * bool(count), "keys": list(content.get("keys", []))}
        if fresh:
            self._write_keys(keys, name)
            out["keys"].append({"name": name, "n": fresh})
        self.versions.commit(base, out)
        self._merge()
        return count

    def _merge(self) -> None:
        """Merges batches of keys of like size, or deals all out to more buckets."""
        base, content = self.versions.latest()
        parts = sorted(content["keys"], key=lambda k: -k["n"])
        total, buckets = sum(k["n"] for k in parts), content["buckets"]
        tail = parts[:]
        while len(tail) > MERGED and tail[0]["n"] > 2 * tail[1]["n"]:
            tail = tail[1:]
        if total > 2 * buckets * self.bucket_keys:
            tail = parts
            while total > buckets * self.bucket_keys:
                buckets *= 4
        elif len(tail) <= MERGED:
            return
        name = f"{content['last']:012d}-merged-{base + 1}"
        keys = self._read("keys", [k["name"] for k in tail], "key string, hash long, bucket long")
        self._write_keys(keys.withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(buckets))), name)
        left = [k for k in content["keys"] if k not in tail]
        self.versions.commit(base, content | {"buckets": buckets, "keys": [*left, {"name": name, "n": sum(k["n"] for k in tail)}]})
        for what in ("keys", "filters"):
            self.versions.clean(what, {f"run={n}" for n in (*(k["name"] for k in left), name)})


def ingest_known(spark: SparkSession, source: str, schema, key: str, target: str, checkpoint: str, fmt: str = "parquet", bucket_keys: int = BUCKET_KEYS, files_per_batch: int | None = None) -> KnownKeys:
    """New files of ``source`` as a stream into a table of known keys under ``target``, until all is read. A stream's batch number is that of its checkpoint, so both folders belong together."""
    known = KnownKeys(spark, target, key, bucket_keys)
    stream = spark.readStream.format(fmt).schema(schema)
    rows = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).load(source)

    def add(batch: DataFrame, number: int) -> None:
        known.ingest(batch, number)

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return known
