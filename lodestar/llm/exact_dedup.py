"""Exact dedup of arriving batches against immutable snapshots.

A snapshot is a table of exact entries (digest, length, smallest id, copies) dealt into buckets, with one static
binary-fuse filter for each bucket. An arriving batch first groups its own duplicates. Its distinct
digests are screened by the filters of the snapshot: what a filter rejects is new for certain; what it passes is joined to the
bucket's exact entries by SHA-256 digest and length, so false positives turn out new, and the texts of both ends are fetched and compared byte for byte.
Different texts of one digest would stop the run; they are never merged. What is new becomes the next snapshot; snapshots are never changed.
Texts are fetched by a second reading behind a bit filter of the ids wanted, so only theirs (and one in sixteen others) are shuffled; where the filter would outgrow ``MOST_BITS``, all are, by the same join.

Two texts are equal if they are identical after each run of blanks became one space; null counts as empty. Of equal texts the smallest id stays;
rows that repeat that id are all marked as kept. A null id stays only where no other row has the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, slot, squeezed, text_batches, written

#: Digests that share a filter; the number of buckets follows the snapshot's size.
BUCKET_KEYS = 50_000
#: Bits of the filter for the second reading of texts: 16 for each id wanted, up to 2 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


@dataclass
class FuseFilter:
    """Three-wise binary fuse filter with one byte a slot: no false negatives, about 1 in 256 false positives."""

    seed: int
    segment: int
    starts: int
    slots: np.ndarray

    @staticmethod
    def _places(x: np.ndarray, segment: int, starts: int) -> np.ndarray:
        first = (x >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        return np.stack([first, (first + np.uint64(segment)) ^ ((x >> np.uint64(18)) & mask), (first + np.uint64(2 * segment)) ^ (x & mask)]).astype(np.int64)

    @staticmethod
    def _prints(x: np.ndarray) -> np.ndarray:
        return ((x ^ (x >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        starts = max(1, math.ceil(room / segment) - 2) * segment
        for seed in range(200):
            x = _mixed(keys, seed)
            places, size = cls._places(x, segment, starts), starts + 2 * segment
            count = np.bincount(places.ravel(), minlength=size)
            owner = np.bincount(places.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
            peeled, front = [], np.flatnonzero(count == 1)
            while len(front):
                key, at = np.unique(owner[front], return_index=True)
                peeled.append((key, front[at]))
                hit = places[:, key].ravel()
                np.subtract.at(count, hit, 1)
                np.subtract.at(owner, hit, np.tile(key, 3))
                hit = np.unique(hit)
                front = hit[count[hit] == 1]
            if sum(len(k) for k, _ in peeled) == n:
                slots = np.zeros(size, np.uint8)
                prints = cls._prints(x)
                for key, slot in reversed(peeled):
                    slots[slot] = prints[key] ^ np.bitwise_xor.reduce(slots[places[:, key]], axis=0)
                return cls(seed, segment, starts, slots)
        raise ValueError("no seed peels these keys")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        x = _mixed(keys.astype(np.uint64), self.seed)
        return self._prints(x) == np.bitwise_xor.reduce(self.slots[self._places(x, self.segment, self.starts)], axis=0)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.starts], np.int64).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FuseFilter:
        return cls(*map(int, np.frombuffer(raw, np.int64, 3)), np.frombuffer(raw, np.uint8, offset=24))


@dataclass
class Snapshot:
    """Immutable: ``entries`` has ``bucket, key, digest, length, keep_id, copies``; ``filters`` has ``bucket, filter``."""

    buckets: int
    entries: DataFrame
    filters: DataFrame


def _filters(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_numpy().astype(np.int64).view(np.uint64)
    return pa.table({"bucket": table.column("bucket")[:1], "filter": pa.array([FuseFilter.build(keys).to_bytes()], pa.binary())})


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.shiftright("key", 7), F.lit(buckets)).cast("int")


def snapshot(groups: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
    """``groups``: ``key, digest, length, keep_id, copies`` with distinct digests. Both tables are written."""
    groups = written(groups, "dedup-groups")
    buckets = max(1, math.ceil(groups.count() / bucket_keys))
    entries = groups.withColumn("bucket", bucket_of(buckets))
    filters = entries.select("bucket", "key").groupBy("bucket").applyInArrow(_filters, "bucket int, filter binary")
    return Snapshot(buckets, entries, written(filters, "dedup-filters"))


def _screen(left: pa.Table, right: pa.Table) -> pa.Table:
    keys = left.column("key").to_numpy().astype(np.int64).view(np.uint64)
    raw = right.column("filter").to_pylist()
    held = FuseFilter.from_bytes(raw[0]).holds(keys) if raw and len(keys) else np.zeros(len(keys), bool)
    return left.append_column("maybe", pa.array(held))


def grouped(digests: DataFrame) -> DataFrame:
    """A batch's own duplicates: one row for each digest."""
    return digests.groupBy("digest", "length").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).withColumn("key", F.xxhash64("digest"))


def screened(groups: DataFrame, against: Snapshot) -> DataFrame:
    """``groups`` with ``maybe``: false if the snapshot doesn't hold the digest for certain."""
    dealt = groups.withColumn("bucket", bucket_of(against.buckets)).select("bucket", "key", "digest", "length", "keep_id", "copies")
    schema = "bucket int, key long, digest binary, length long, keep_id long, copies long, maybe boolean"
    return dealt.groupBy("bucket").cogroup(against.filters.groupBy("bucket")).applyInArrow(_screen, schema)


def _digest(plain: Column) -> Column:
    return F.unhex(F.sha2(plain, 256))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest, length`` of each row's text with blanks squeezed."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), squeezed(text).alias("plain"))
    return plain.select("doc_id", _digest(F.col("plain")).alias("digest"), F.octet_length("plain").cast("long").alias("length"))


def _behind(rows: DataFrame, wanted: DataFrame, most_bits: int) -> DataFrame:
    """Those of the ``name, text`` rows whose name is wanted, and few others."""
    bits = max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length())
    if bits > most_bits:
        return rows
    text_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(bit_filter(wanted, "name", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(in_filter(sent.value, batch.column(2))).select([0, 1])

    return rows.select("name", "text", slot("name", bits).alias("slot")).mapInArrow(run, "name string, text string")


def proved(docs: DataFrame, hits: DataFrame, text: str = "text", doc_id: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """``digest`` of the ``hits`` (``digest, keep_id, old_id``) whose texts at both ends are the same bytes; raises where they differ.

    Rows without an id are found by their digest.
    """
    name = lambda i: F.coalesce(F.col(i).cast("string"), F.hex("digest"))
    ends = hits.select("digest", name("keep_id").alias("new"), name("old_id").alias("old"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.when(F.col("id").isNull(), F.hex(_digest(squeezed("text")))).otherwise(F.col("id").cast("string")).alias("name"), "text")
    wanted = ends.select(F.explode(F.array("new", "old")).alias("name")).distinct()
    texts = _behind(rows, wanted, most_bits).select("name", squeezed("text").alias("plain")).withColumn("digest", _digest(F.col("plain")))
    # One shuffle, by digest, serves the join and the comparison, at every size.
    both = texts.join(ends.hint("merge"), "digest").filter(F.col("name").isin(F.col("new"), F.col("old")))
    ends_of = both.groupBy("digest").agg(F.min("plain").alias("low"), F.max("plain").alias("high"))
    return ends_of.select(F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(F.raise_error(F.lit("different texts have one digest")).cast("binary")).alias("digest"))


def exact_dedup(docs: DataFrame, batches: int = 2, text: str = "text", doc_id: str = "doc_id", bucket_keys: int = BUCKET_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Documents arrive in ``batches`` of about equal size by id; each is screened against the snapshots of those before it.
    """
    rows = written(digests(docs, text, doc_id), "dedup-digests")
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / batches) for k in range(1, batches))), 10_000)).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    parts: list[DataFrame] = []
    snapshots: list[Snapshot] = []
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
        inside = inside if high is None else inside & (F.col("doc_id") <= high)
        new = grouped(rows.filter(inside)).select("key", "digest", "length", "keep_id", "copies")
        for old in snapshots:
            marked = written(screened(new, old), "dedup-screened")
            exact = old.entries.select("digest", "length", F.col("keep_id").alias("old_id"), F.lit(True).alias("met"))
            joined = marked.filter("maybe").join(exact, ["digest", "length"], "left")
            hits = written(joined.filter("met").select("digest", "keep_id", "old_id", "copies"), "dedup-hits")
            parts.append(hits.join(proved(docs, hits, text, doc_id, most_bits), "digest").select("digest", F.col("old_id").alias("keep_id"), "copies"))
            fresh = ["key", "digest", "length", "keep_id", "copies"]
            new = marked.filter(~F.col("maybe")).select(*fresh).unionByName(joined.filter("met is null").select(*fresh))
        snapshots.append(snapshot(new, bucket_keys))
    for old in snapshots:
        parts.append(old.entries.select("digest", "keep_id", "copies"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    groups = every.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = rows.join(groups, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
