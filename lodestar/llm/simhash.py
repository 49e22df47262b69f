"""SimHash near-dedup: fingerprints of 64 bits, linked at a few differing bits, by Gray-order hierarchical indexes.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes (seed 42) of a text's shingles, repeats included. Distinct fingerprints are nodes; a node stands for all rows that have it.

Two fingerprints that differ in at most ``most`` bits agree in one of ``most + 1`` parts of any bits. So rows are dealt to one bucket for each part, by its bits; a bucket with more than ``bucket_rows`` fingerprints
is dealt again by the parts of the bits that it hasn't fixed, until buckets are small: no link is lost, as any two linked ones share a bucket at each step. Each step fixes more bits, so this ends.

A bucket's index: fingerprints sorted by Gray rank, so neighbours differ in few bits. Groups of neighbours are factored into nodes, level by level: a node has the bits that all its members share, as a mask and a pattern.
The join goes down from the root with pairs of nodes: the bits that both patterns fix and that differ are the differences gathered so far; a pair with more than ``most`` is dropped with all below it. Pairs of fingerprints left at the bottom are links.
Of a bucket's links those of a spanning forest are told, so groups of copies give no pairs; components over all buckets are then found by alternating stars.

Texts are lower-cased (A-Z); words are what blanks part; a text of fewer words than a shingle is one shingle; a null text counts as empty, and a text without words has fingerprint zero, which is linked like any other.
Repeated rows give a row each. A null id is a row of its own; a component whose rows have no id has none. Other columns aren't read. Memory is bounded by a batch of texts, the words of the longest, and a batch of fingerprints with one bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Hashes of a text that are summed at once.
SLICE_HASHES = 1 << 18
#: Fingerprints of a bucket that an index takes, members of a group, pairs of nodes that are compared at once.
BUCKET_ROWS, FAN, PAIRS = 2048, 8, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def _bits_over_half(hashes: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Adds how often each bit is set."""
    for i in range(0, len(hashes), SLICE_HASHES):
        some = hashes[i : i + SLICE_HASHES]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of the text's shingles of ``size`` words."""
    words = text.translate(_LOWER).split(b" ")
    plain = b" ".join(filter(None, words))
    if not plain:
        return 0
    blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(plain)]))
    n = max(1, len(starts) - size + 1)
    view, digest = memoryview(plain), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SLICE_HASHES):
        first = starts[i : min(i + SLICE_HASHES, n)].tolist()
        last = ends[min(size, len(ends)) - 1 + i :][: len(first)].tolist()
        ones = _bits_over_half(np.fromiter((digest(view[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first)), ones)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, print``: the fingerprint of each row's text as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, print long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in the order in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by bucket and Gray rank; a node lies in one bucket."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray, fan: int = FAN) -> None:
        # Level 0: a node for each fingerprint, which fixes all bits.
        self.masks = [np.full(len(prints), ~np.uint64(0))]
        self.patterns = [prints]
        self.first: list[np.ndarray] = []
        while len(bucket):
            new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            if new.all():
                break
            start = np.flatnonzero(new)
            place = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            first = np.flatnonzero(place % fan == 0)
            patterns, masks = self.patterns[-1], self.masks[-1]
            agree = np.bitwise_and.reduceat(masks, first)
            # Bits on which a member differs from the others: set in some patterns and clear in others.
            every, some = np.bitwise_and.reduceat(patterns, first), np.bitwise_or.reduceat(patterns, first)
            agree &= ~(every ^ some)
            self.masks.append(agree)
            self.patterns.append(every & agree)
            self.first.append(np.append(first, len(bucket)))
            bucket = bucket[first]

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of fingerprints that differ in ``most`` bits or fewer and share a bucket, the lower place first; each pair once."""
        top = len(self.first)
        roots = np.arange(len(self.patterns[top]))
        stack = [(top, roots, roots)] if top else []
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > PAIRS // FAN**2:
                half = len(a) // 2
                stack += ((level, a[:half], b[:half]), (level, a[half:], b[half:]))
                continue
            first = self.first[level - 1]
            wide, tall = first[a + 1] - first[a], first[b + 1] - first[b]
            each = wide * tall
            pair = np.repeat(np.arange(len(a)), each)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            x, y = first[a][pair] + place // tall[pair], first[b][pair] + place % tall[pair]
            masks, patterns = self.masks[level - 1], self.patterns[level - 1]
            differ = np.bitwise_count((patterns[x] ^ patterns[y]) & masks[x] & masks[y])
            keep = (differ <= most) & ((x < y) if level == 1 else (x <= y))
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))


def _roots(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The lowest place that each place reaches."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _part(bits: Column, most: int) -> Column:
    """The masks of ``most + 1`` parts of the bits that aren't in ``bits``, each with ``bits``."""
    clear = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 0)
    parts = F.sequence(F.lit(0), F.lit(most))

    def mask(free: Column, part: Column) -> Column:
        n = F.size(free)
        begin, end = F.floor(part * n / (most + 1)).cast("int"), F.floor((part + 1) * n / (most + 1)).cast("int")
        return F.aggregate(F.slice(free, begin + 1, end - begin), bits, lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))

    return F.array_distinct(F.flatten(F.transform(F.array(clear), lambda free: F.transform(parts, lambda part: mask(free, part)))))


def dealt(prints: DataFrame, most: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``print, mask, value``: each distinct fingerprint in the buckets where its links are found, once; a bucket lies in one partition."""
    # A bucket with fewer clear bits than parts holds no more than this.
    bucket_rows = max(bucket_rows, 1 << most)
    rows = prints.select("print", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    done: DataFrame | None = None
    while True:
        sizes = written(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > bucket_rows).select("mask", "value"), "large-buckets")
        small = rows.join(sizes, ["mask", "value"], "left_anti")
        done = small if done is None else done.unionByName(small)
        masks = sizes.select("mask").distinct().select("mask", F.explode(_part(F.col("mask"), most)).alias("next"))
        if not sizes.head(1):
            # A bucket has all fingerprints with its bits, so one that several rounds deal is the same in each.
            return done.repartition("mask", "value").distinct()
        large = rows.join(sizes, ["mask", "value"], "left_semi").join(masks, "mask")
        rows = written(large.select("print", F.col("next").alias("mask"), F.col("print").bitwiseAND(F.col("next")).alias("value")).distinct(), "buckets")


def print_links(prints: DataFrame, most: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``u, v``: links between distinct fingerprints that join all that reach each other inside a bucket."""

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray_rank(x).view(np.int64))], names=[*batch.schema.names, "rank"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            new = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            bucket = np.concatenate(([0], np.cumsum(new)))
            x = np.ascontiguousarray(rows[:, 2])
            root = _roots(len(x), GrayIndex(x.view(np.uint64), bucket).links(most))
            tied = np.flatnonzero(root != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[tied]), pa.array(x[root[tied]])], names=["u", "v"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows])
            # The last bucket may go on in the next batch.
            open_ = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            end = int(np.argmax(open_))
            held = [rows[end:]]
            if end:
                yield linked(rows[:end])
        if held and len(held[0]):
            yield linked(held[0])

    schema = "print long, mask long, value long, rank long"
    ranked = dealt(prints, most, bucket_rows).select("print", "mask", "value").mapInArrow(rank, schema)
    sorted_ = ranked.sortWithinPartitions("mask", "value", "rank").select("mask", "value", "print")
    return sorted_.mapInArrow(join, "u long, v long")


def simhash_components(docs: DataFrame, size: int = 5, most: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``: the smallest id that can be reached over fingerprints that differ in ``most`` bits or fewer."""
    rows = written(fingerprints(docs, size), "fingerprints")
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(written(print_links(prints, most, bucket_rows), "fingerprint-links"))
    named = prints.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "fingerprint-components")
    ids = written(named.join(least, "component").select("print", "component_id"), "fingerprint-ids")
    return rows.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
