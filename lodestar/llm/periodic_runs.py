"""Runs of repeated words: masking by repeated k-grams, then Main-Lorentz on what is left.

A run is a stretch of words with smallest period q and at least ``max(min_length, min_exponent * q)`` words that no neighbouring word extends.
Each stretch of k words inside a run recurs q words away inside it, with k no larger than the run less two periods, plus one. The smallest such number over all q is k:
so a word that lies in no k-gram that the document repeats can join no run. Such words are masked (k-grams are told by 64-bit hashes: two that meet mask less, never more).
What stays falls into segments, and a run lies in one segment with the word that would extend it, so Main-Lorentz needs no other words: each node of its halving looks for runs over its middle
by Z-functions of both halves; a run belongs to the highest node whose middle it holds, so what touches a node's edge and goes on beyond is left to that node.

Texts are worked through some megabytes at a time, and a long one is split into words a megabyte at a time. Memory is bounded by the longest text: 4 bytes a word, and its distinct words.
A null text counts as empty: no runs, an empty collapsed text. Rows are told apart by nothing but their place: repeated rows and ids, and rows without an id, give a row each. Other columns than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_array

#: Bytes of text that are worked through at once, and that are split at once.
SLICE_BYTES, SPLIT_BYTES = 4 << 20, 1 << 20

Run = tuple[int, int, int]

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])


def overlap(min_length: int, min_exponent: int) -> int:
    """k: the smallest length, over all periods, of a run less two periods, plus one. With an exponent of two or more, no period above ``min_length`` lowers it."""
    return max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1)))


def _z(s: list[int], n: int) -> list[int]:
    """For each place below ``n`` the length of the longest prefix of ``s`` that begins there."""
    z = [0] * n
    left = right = 0
    total = len(s)
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < total and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def segment_runs(s: list[int], min_length: int, min_exponent: int) -> list[Run]:
    """``start, length, period`` of all runs, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    nodes = [(0, len(s))]
    n = len(s)
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo < min_length:
            continue
        mid = (lo + hi) // 2
        nodes += ((lo, mid), (mid, hi))
        # A run over the middle has half its words or more, two periods at least, on one side.
        most = min((hi - lo) // min_exponent, max(mid - lo, hi - mid))
        u, v = s[lo:mid][::-1], s[mid:hi]
        heads = _z(v, min(len(v), most + 1))
        tails = _z(u, min(len(u), most + 1))
        # Words after the middle against those of q words before, and words before it against those of q words after.
        over = _z(v + [-1] + u[:most][::-1] + v, len(v) + 1 + min(len(u), most))
        under = _z(u + [-1] + v[:most][::-1] + u, len(u) + 1 + min(len(v), most))
        for q in range(1, most + 1):
            least = max(min_length, min_exponent * q)
            found = []
            if q <= len(v):
                found.append((mid - under[len(under) - q], mid + q + (heads[q] if q < len(heads) else 0)))
            if q <= len(u):
                found.append((mid - q - (tails[q] if q < len(tails) else 0), mid + over[len(over) - q]))
            for start, end in found:
                if end - start < least or (start > 0 and s[start - 1] == s[start - 1 + q]) or (end < n and s[end] == s[end - q]):
                    continue
                best[start, end] = min(q, best.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in best.items())


def _spread(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether one of the k-grams that begin ``at`` covers each of ``n`` words."""
    step = np.zeros(n + 1, np.int64)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step[:n]) > 0


def survivors(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs in their document more than once."""
    n = len(ids)
    if n < k:
        return np.zeros(n, bool)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = (doc[: n - k + 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
    for j in range(k):
        grams = (grams ^ mixed[j : n - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
        grams ^= grams >> np.uint64(32)
    whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    grams = grams[whole]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _spread(whole[twice], k, n)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words, those of a megabyte at a time."""
    at = 0
    while at < len(data):
        end = at + SPLIT_BYTES
        # A word that is cut belongs to this part as a whole.
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def _found(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[list[Run], bytes]]:
    """Of each text its runs, and the text without what repeats a run's first period."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts = [[np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in _words(t)] for t in texts]
    ids = [np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]
    words = list(number)
    sizes = np.array([len(x) for x in ids], np.int64)
    stay = survivors(np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes), overlap(min_length, min_exponent))
    begin = 0
    for own, size in zip(ids, sizes.tolist(), strict=True):
        runs: list[Run] = []
        mask = stay[begin : begin + size]
        begin += size
        if mask.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).tolist()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= min_length:
                    runs += [(a + start, length, q) for start, length, q in segment_runs(own[a:b].tolist(), min_length, min_exponent)]
        if runs:
            drop = np.zeros(size + 1, np.int64)
            for start, length, q in runs:
                drop[start + q] += 1
                drop[start + length] -= 1
            own = own[np.cumsum(drop[:size]) == 0]
        yield runs, b" ".join(map(words.__getitem__, own.tolist()))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        at, size = 0, 0
        for i, length in enumerate(pa.compute.binary_length(texts).to_pylist()):
            size += length or 0
            if size >= SLICE_BYTES or i == len(texts) - 1:
                yield doc_ids[at : i + 1], [t or b"" for t in texts[at : i + 1].to_pylist()]
                at, size = i + 1, 0


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``doc_id``, ``runs`` (``start, length, period`` in words, by start, then period) and ``text``: the words that are left, joined by a space, once each run has its first period only."""
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has two periods and two words at least")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _slices(batches):
            runs, left = zip(*_found(texts, min_length, min_exponent), strict=True)
            told = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(told, ARROW.field(1).type), pa.array(left, pa.binary()).cast(pa.string())], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, f"doc_id long, runs {RUNS}, text string")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the documents, by the CRC-32 of the decimal id, repeat a stretch of their words to the end. A row without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    dealt = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, word_array("text")).alias("words"))
    n, g = F.size("words"), F.col("g")
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")

    def part(words: Column, start: Column, length: Column) -> Column:
        return F.slice(words, start + 1, length)

    cycle = F.flatten(F.array_repeat(part(F.col("words"), a, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(part(F.concat(part(F.col("words"), F.lit(0), a), cycle), F.lit(0), n), " ")
    return dealt.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of :func:`periodic_runs`."""
    longest = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    return top.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
