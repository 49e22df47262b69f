"""Removal of long byte strings that occur more than once, by a sampled suffix order.

Two equal strings of ``length`` bytes both hold a sample at the same offset, if samples are the smallest of the hashes of
32 bytes inside every such string: a cover that follows the content. Each sample owns the run of string starts of which it is the smallest, with the bytes they span.
Samples with the same 32 bytes form a suffix bucket, and buckets are worked through one after the other, a bounded batch at a time:

- runs of a bucket with equal bytes are one rank; a rank that occurs twice or more is removed whole, whatever its length: long ties never get compared again;
- where a bucket has several ranks, the strings of its ranks are sorted by their fingerprints, and those that two ranks share are removed.

A bucket with very many ranks is dealt out string by string instead. Rows of one text (equal copies) are one text with a count.
Fingerprints have 64 bits. Bytes are judged on the input; matches don't cross documents. Null counts as empty; a text shorter than ``length`` loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_batches, written

LENGTH = 400
#: Bytes that a sample hashes.
GRAM = 32
#: Bytes of text or of ranks that a task works on at a time; it takes about 80 times as much memory. Longer texts are cut into overlapping pieces.
BATCH_BYTES = 2 << 20
#: Ranks of a bucket up to which one task compares them.
BUCKET_RANKS = 10_000

SAMPLES = "text_hi long, text_lo long, bucket long, rank long, low int, high int, anchor int"
PLACE = np.uint64((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes at each place, as a number."""
    n = len(raw) - 7
    out = np.empty(max(0, n), np.uint64)
    for k in range(min(8, max(0, n))):
        out[k::8] = np.frombuffer(raw, "<u8", (n - k + 7) // 8, k)
    return out


def samples(raw: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For texts that end at ``ends`` inside ``raw``: bucket, first start, last start and place of each sample."""
    y = _mix(eights(raw))
    m = len(raw) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none
    h = _mix(sum((y[8 * k : 8 * k + m] * np.uint64(2 * 0x632BE59BD9B4E019 * k + 1 & (1 << 64) - 1) for k in range(GRAM // 8)), np.zeros(m, np.uint64)))
    packed = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
    w = length - GRAM + 1
    padded = np.full(-(-m // w) * w, np.uint64((1 << 64) - 1))
    padded[:m] = packed
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(raw) - length + 1
    smallest = np.minimum(after[:starts], before[w - 1 : w - 1 + starts])
    at = (smallest & PLACE).astype(np.int64)
    text = np.searchsorted(ends, np.arange(starts), side="right")
    whole = np.arange(starts) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.concatenate([[True], at[1:] != at[:-1]]) | np.concatenate([[True], ~whole[:-1]])
    low = np.flatnonzero(new & whole)
    stop = np.flatnonzero(new | ~whole)
    following = np.searchsorted(stop, low, side="right")
    high = np.where(following < len(stop), stop[np.minimum(following, len(stop) - 1)], starts) - 1
    return h[at[low]], low, high, at[low]


def _sampled(length: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            raw = b"".join(k[2] for k in held)
            ends = np.cumsum([len(k[2]) for k in held])
            bucket, low, high, at = samples(raw, ends, length)
            rank = np.array([xxhash.xxh3_64_intdigest(raw[a : b + length], seed=c - a) for a, b, c in zip(low.tolist(), high.tolist(), at.tolist(), strict=True)], np.uint64)
            text = np.searchsorted(ends, low, side="right")
            base = (ends - [len(k[2]) + k[3] for k in held])[text]
            key = np.array([k[:2] for k in held], np.int64)[text].reshape(-1, 2)
            return pa.RecordBatch.from_pydict(
                {"text_hi": key[:, 0], "text_lo": key[:, 1], "bucket": bucket.view(np.int64), "rank": rank.view(np.int64), "low": (low - base).astype(np.int32), "high": (high - base).astype(np.int32), "anchor": (at - base).astype(np.int32)}
            )

        for batch in batches:
            for hi, lo, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(raw) - length + 1, batch_bytes):  # pieces share no start of a string
                    held.append((hi, lo, raw[at : at + batch_bytes + length - 1], at))
                    size += len(held[-1][2])
                    if size >= batch_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _cut(length: int):
    """The bytes of wanted ranks, from the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("raw", "wanted")), strict=True):
                out += [(w["bucket"], w["rank"], w["many"], w["anchor"] - w["low"], raw[w["low"] : w["high"] + length]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], ["bucket", "rank", "many", "shift", "bytes"])

    return run


def fingerprints(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint of every string of ``length`` bytes inside each span, and the number of strings in each."""
    raw = b"".join(spans)
    y = _mix(eights(raw))
    factor = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(factor), -1, 1 << 64))
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, len(y) - 1), factor))])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, len(y) - 1), inverse))])
    upto = np.concatenate([[np.uint64(0)], np.cumsum(y * power[: len(y)])])
    counts = np.array([len(s) - length + 1 for s in spans])
    base = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
    start = np.repeat(base - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return _mix((upto[start + length - 7] - upto[start]) * back[start]), counts


def _runs_of(hit: np.ndarray) -> list[int]:
    """First and last place of each run of true values, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _compared(length: int):
    """Buckets in order, a batch of whole buckets at a time: the strings that two ranks of a bucket share."""
    names = {"bucket": pa.int64(), "rank": pa.int64(), "runs": pa.list_(pa.int32())}

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        prints, counts = fingerprints([r[4] for r in rows], length)
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        hit = np.zeros(len(prints), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        parts = np.split(hit, np.cumsum(counts)[:-1])
        out = [(r[0], r[1], _runs_of(part)) for r, part in zip(rows, parts, strict=True) if not r[2] and part.any()]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(names.values())], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def _dealt(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, rank, many, _, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints, counts = fingerprints([span], length)
                n = int(counts[0])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * n, pa.int64()), "rank": pa.array([rank] * n, pa.int64()), "many": pa.array([many] * n, pa.bool_()), "place": pa.array(range(n), pa.int32()), "print": prints.view(np.int64)})

    return run


def _joined_runs(places: list[int]) -> list[int]:
    hit = np.zeros(max(places) + 1, bool)
    hit[places] = True
    return _runs_of(hit)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((s["low"], s["high"] + length) for s in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((doc_id, len(raw), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [x for s in merged for x in s]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def text_names(raw: str = "raw") -> tuple[Column, Column]:
    """128 bits that name a text: two hashes with seeds of their own."""
    return F.xxhash64(raw).alias("text_hi"), F.xxhash64(F.lit(7), raw).alias("text_lo")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", bucket_ranks: int = BUCKET_RANKS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row; ``spans`` has the start and end of each removed run in turn."""
    spark = docs.sparkSession
    text_batches(spark)
    n = partitions(spark)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("raw")).select("doc_id", *text_names(), "raw")
    found = whole.select("text_hi", "text_lo", "raw").mapInArrow(_sampled(length, batch_bytes), SAMPLES)
    key = ["text_hi", "text_lo"]
    # Equal copies of a text are one text; how many there are shows in the count of its samples.
    found = written(found.groupBy("bucket", "rank", *key, "low", "high", "anchor").agg(F.count(F.lit(1)).alias("copies")), "samples")
    place = F.struct(*key, "low", "high", "anchor").alias("place")
    ranks = found.groupBy("bucket", "rank").agg(F.sum("copies").alias("copies"), F.min(place).alias("place"))
    shared = found.groupBy("bucket").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("copies").alias("all"), F.approx_count_distinct("rank").alias("about")).filter("all > 1")
    ranks = written(ranks.join(shared, "bucket").select("bucket", "rank", (F.col("copies") > 1).alias("many"), "place", (F.col("first") < F.col("last")).alias("mixed"), "about"), "ranks")
    wanted = ranks.filter("mixed").groupBy("place.text_hi", "place.text_lo").agg(F.collect_list(F.struct("bucket", "rank", "many", "place.low", "place.high", "place.anchor", "about")).alias("wanted"))
    texts = whole.groupBy(*key).agg(F.min("doc_id").alias("one")).join(wanted, key).select(*key, "one", "wanted")
    cut = whole.join(texts.hint("merge"), key).filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("raw", "wanted")
    small, large = (cut.select("raw", F.filter("wanted", f).alias("wanted")).filter(F.size("wanted") > 0).mapInArrow(_cut(length), "bucket long, rank long, many boolean, shift int, bytes binary") for f in (lambda w: w["about"] <= bucket_ranks, lambda w: w["about"] > bucket_ranks))
    partial = small.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_compared(length), "bucket long, rank long, runs array<int>")
    if ranks.filter(F.col("mixed") & (F.col("about") > bucket_ranks)).limit(1).count():
        strings = written(large.dropDuplicates(["bucket", "rank"]).mapInArrow(_dealt(length), "bucket long, rank long, many boolean, place int, print long"), "strings")
        twice = strings.groupBy("bucket", "print").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).filter("a <> b").select("bucket", "print")
        runs = F.udf(_joined_runs, "array<int>")
        partial = partial.unionByName(strings.filter("not many").join(twice, ["bucket", "print"]).groupBy("bucket", "rank").agg(runs(F.collect_list("place")).alias("runs")))
    partial = written(partial.dropDuplicates(["bucket", "rank"]), "partial")
    verdict = ranks.filter("many").select("bucket", "rank", F.lit(None).cast("array<int>").alias("runs")).unionByName(partial)
    hits = found.join(verdict, ["bucket", "rank"])
    pair = F.when(F.col("runs").isNull(), F.array(F.struct(F.col("low").alias("low"), F.col("high").alias("high")))).otherwise(
        F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda k: F.struct((F.col("low") + F.element_at("runs", 2 * k + 1)).alias("low"), (F.col("low") + F.element_at("runs", 2 * k + 2)).alias("high")))
    )
    spans = hits.select(*key, pair.alias("pairs")).groupBy(*key).agg(F.flatten(F.collect_list("pairs")).alias("spans"))
    both = whole.join(spans.hint("merge"), key, "left").select("doc_id", "raw", "spans")
    return both.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
