"""Toxicity from two class-conditional Kneser-Ney language models of word pairs.

For each class c, with h the word before w and D the discount:

- p_c(w | h) = max(c_c(hw) - D, 0) / c_c(h) + b_c(h) p_c(w), interpolated; c_c counts occurrences, b_c(h) is the share that the discounts of h's pairs leave over.
- p_c(w) = max(n_c(w) - D, 0) / N_c + (D T_c / N_c) n(w) / N. n_c(w) is the continuation count: the number of distinct words that precede w in the class's
  labelled documents, whatever its frequency. N_c is its sum, T_c the number of words with n_c > 0; n and N are the same summed over both classes, the shared backoff.

An expression whose class counts stay within ``z`` standard deviations of their expected share is a rare or neutral one: its own counts are discounted in full.
A pair is judged by the documents that hold it, against the share of its history; those of a class in excess that have the same words around it, as copies have, count once. A neutral pair's mass goes to b_c(h) and w is predicted by the shorter history, p_c(w).
A word is judged by the documents that hold it, against the share of all words'; a neutral one has n(w) / N in both classes. A document's evidence is
(log p_toxic - log p_ordinary) / words over all its words in their context; a logistic curve fitted on the training rows turns it into a score.

Of a model of order one, a word's history is its document: n_c(w) is the number of documents that hold w, and no longer expressions are read.
The beginning of a text is a history like any other: the first word is predicted by how texts of the class begin, and it is one of the words that can precede w.

All labelled rows outside the held-out fifth train; nothing is sampled. Null or empty texts have evidence 0, as have texts without letters: they score the base rate. A row with a null id is scored but never trains. Of several
labels for one id the largest counts. Without labels of both classes the score is the base rate. Words without letters are passed over, also as histories. Hashes of 64 bits stand for words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, rows_of, slot, text_batches, written

DISCOUNT = 0.75
#: Standard deviations from the expected share beyond which a word has a class of its own.
Z = 4.0
#: Words of the longest expressions of the query's model.
ORDER = 2
#: Words that a task gathers before it passes them on.
GATHER_WORDS = 1 << 20
#: Words that a task scores at a time; a longer text is scored at once.
SCORE_WORDS = 1 << 16
#: The model is broadcast up to this many expressions (about 100 bytes each), beyond it is joined.
BROADCAST_WORDS = 200_000
#: Evidence is summed in whole units of this size: a sum is the same in any order.
UNIT = 2.0**-32
#: Bins of evidence for the curve: all that reaches the driver besides the model.
BINS, BIN_WIDTH = 4096, 1 / 1024
#: Bits of the filter of labelled ids: 16 for each, up to 2 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24

EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Makes the name of a pair from those of its words.
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of 64 for the words around a pair, beyond which they are taken to be as many as its documents.
FULL = 56
#: Histories are dealt to tasks in this many buckets.
BUCKETS = 4096
#: Labelled rows up to which their ids and marks go to every task; beyond, labelled texts go to the join.
BROADCAST_MARKS = 250_000


def plain(word: str) -> str:
    """Lower case, without what isn't a letter at either end."""
    return EDGES.sub("", word.lower())


class _Plain(dict):
    """Remembers the plain form of each word; starts afresh when it has grown large."""

    def __missing__(self, word: str) -> str:
        if len(self) > GATHER_WORDS:
            self.clear()
        self[word] = p = plain(word)
        return p


def name(word: str) -> int:
    """The hash that stands for a plain word, as ``F.xxhash64`` has it but unsigned; the empty word begins a text."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)


BEGIN = np.uint64(name(""))


class _Names(dict):
    """Remembers the name of each word's plain form, 0 if it has none; starts afresh when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > GATHER_WORDS:
            self.clear()
        p = plain(word)
        self[word] = n = name(p) if p else 0
        return n


def _in_context(words: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of each word that has a plain form, for texts of ``sizes`` words on end."""
    held = words != 0
    w, text = words[held], np.repeat(np.arange(len(sizes)), sizes)[held]
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.concatenate([[True], text[1:] != text[:-1]])[: len(w)]] = BEGIN
    return h, w, text


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple], np.ndarray, list[int]]]:
    """Rows of ``text`` and what else they hold, with the names and numbers of their words, gathered up to ``most`` words."""
    names, rows, held, sizes = _Names(), [], [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = row[0].split()
            rows.append(row[1:])
            held.extend(map(names.__getitem__, found))
            sizes.append(len(found))
            if len(held) > most:
                yield rows, np.array(held, np.uint64), sizes
                rows, held, sizes = [], [], []
    if rows:
        yield rows, np.array(held, np.uint64), sizes


#: Counts of a bucket's words, of its pairs seen once and of those seen more often, as columns of bytes.
WORDS, ONCE, MORE = ("u8", "u4", "u4", "u4", "u4"), ("u8", "u1"), ("u8", "u4", "u4", "u4", "u4", "u8", "u8")


def _packed(kinds: tuple[str, ...], columns: list[np.ndarray], part: slice) -> bytes:
    """Columns byte by byte: the upper bytes of small numbers stand together and take no room when compressed."""
    return b"".join(np.ascontiguousarray(c[part], k).view(np.uint8).reshape(-1, np.dtype(k).itemsize).T.tobytes() for k, c in zip(kinds, columns, strict=True))


def _unpacked(kinds: tuple[str, ...], raw: bytes) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at = len(raw) // sum(sizes), np.cumsum([0, *sizes])
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * m, n * at[i]).reshape(m, n).T).view(k).ravel() for i, (k, m) in enumerate(zip(kinds, sizes, strict=True))]


def _merged(keys: list[np.ndarray], sums: list[np.ndarray], masks: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys in order, with their sums and united masks."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])[: len(order)])
    return [*(k[at] for k in keys), *(np.add.reduceat(x[order], at) for x in sums), *(np.bitwise_or.reduceat(x[order], at) for x in masks)] if len(at) else [*keys, *sums, *masks]


def _gather_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of histories: the documents of either class that hold a history at all, and for each word after it documents, occurrences and the words around both, a bit of 64 each."""
    for rows, words, sizes in _texts(batches, GATHER_WORDS):
        h, w, text = _in_context(words, sizes)
        if not len(w):
            continue
        toxic = np.array([r[0] for r in rows], np.int64)
        following = np.where(np.append(text[1:] != text[:-1], True), BEGIN, np.roll(w, -1))
        before = np.where(h == BEGIN, BEGIN, np.roll(h, 1))
        around = np.uint64(1) << ((before * PAIR ^ following) * PAIR >> np.uint64(58))
        one = toxic[text]
        h0, w0, t0, c0, c1, m0, m1 = _merged([h, w, text], [1 - one, one], [np.where(one == k, around, np.uint64(0)) for k in (0, 1)])
        h0, w0, d0, d1, c0, c1, m0, m1 = _merged([h0, w0], [1 - toxic[t0], toxic[t0], c0, c1], [m0, m1])
        v, t0 = _merged([w, text], [], [])
        v, e0, e1 = _merged([np.append(v, BEGIN)], [np.append(1 - toxic[t0], 0), np.append(toxic[t0], 0)], [])
        once = c0 + c1 == 1
        where = np.searchsorted(v, h0)
        pieces = []
        for kinds, chosen, columns in (
            (ONCE, once, [w0, (c1 << 6) + np.log2((m0 | m1).astype(np.float64)).astype(np.int64)]),
            (MORE, ~once, [w0, d0, d1, c0, c1, m0, m1]),
        ):
            pieces.append((kinds, h0[chosen], [c[chosen] for c in columns], np.bincount(where[chosen], minlength=len(v))))
        pieces.append((WORDS, v, [v, e0, e1, pieces[0][3], pieces[1][3]], None))
        cut = []
        for kinds, of, columns, _ in pieces:
            bucket = (of & np.uint64(BUCKETS - 1)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            cut.append((kinds, [c[order] for c in columns], np.searchsorted(bucket[order], np.arange(BUCKETS + 1))))
        held = [(k, *(_packed(kinds, columns, slice(at[k], at[k + 1])) for kinds, columns, at in cut)) for k in np.flatnonzero(np.diff(cut[2][2])).tolist()]
        for k in range(0, len(held), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held[k : k + 256], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "once", "more", "words"])


def _apart(z: float, d: list[np.ndarray], m: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """Pairs that tell the classes apart, where toxic documents have ``share`` of their history.

    What the class in excess says in the same words around the pair, as copies do, counts once, as long as these words don't fill the bits.
    """
    filled = [np.bitwise_count(x).astype(np.int64) for x in m]
    seen = [np.where(f > FULL, x, np.minimum(x, np.rint(-64 * np.log1p(-np.minimum(f, FULL) / 64)))) for f, x in zip(filled, d, strict=True)]
    more, less = (d[0] + seen[1]) * share, (seen[0] + d[1]) * share
    return np.where(d[1] > (d[0] + d[1]) * share, seen[1] - more > z * np.sqrt(more) + 1, less - d[1] > z * np.sqrt(less) + 1)


SUMS = "h long, w long, n0 long, n1 long, d0 long, d1 long, o0 double, o1 double, b0 double, b1 double"


def _by_history(z: float):
    """Whole buckets: rows ``(0, w)`` with continuation counts and documents of words, as far as known here, and rows ``(h, w)`` of the pairs told, with what is left of their share and the backoff weights of ``h``."""
    names = [c.split()[0] for c in SUMS.split(", ")]

    def row(h: np.ndarray, w: np.ndarray, longs: list[np.ndarray], doubles: list[np.ndarray]) -> pa.RecordBatch:
        none = np.zeros(len(w))
        longs, doubles = longs or [none.astype(np.int64)] * 4, doubles or [none] * 4
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), w.view(np.int64), *(x.astype(np.int64) for x in longs), *(x.astype(np.float64) for x in doubles))], names)

    def solve(rows: list[tuple]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        parts, words = [], []
        for _, once, more, own in rows:
            v, e0, e1, k1, k2 = _unpacked(WORDS, own)
            words.append([v, e0, e1])
            w, tag = _unpacked(ONCE, once)
            c1, bit = (tag >> 6).astype(np.int64), np.uint64(1) << (tag & 63).astype(np.uint64)
            masks = [np.where(c1 == k, bit, np.uint64(0)) for k in (0, 1)]
            parts.append([np.repeat(v, k1), w, 1 - c1, c1, 1 - c1, c1, *masks])
            w, *counts, m0, m1 = _unpacked(MORE, more)
            parts.append([np.repeat(v, k2), w, *(c.astype(np.int64) for c in counts), m0, m1])
        h, w, d0, d1, c0, c1, m0, m1 = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, w, d0, d1, c0, c1, m0, m1 = _merged([h, w], [d0, d1, c0, c1], [m0, m1])
        v, e0, e1 = (np.concatenate(x) for x in zip(*words, strict=True))
        none = np.zeros(len(v), np.int64)
        less = [np.concatenate(x) for x in ((w, v), ((c0 > 0).astype(np.int64), none), ((c1 > 0).astype(np.int64), none), (np.zeros(len(w), np.int64), e0), (np.zeros(len(w), np.int64), e1))]
        first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        at, of = np.flatnonzero(first), np.cumsum(first) - 1
        if not len(h):
            return row(h, w, [], []), less
        sums = [np.add.reduceat(x, at) for x in (d0, d1, c0, c1)]
        told = np.flatnonzero(_apart(z, [d0, d1], [m0, m1], (sums[1] / (sums[0] + sums[1]))[of]))
        own = [np.maximum(c[told] - DISCOUNT, 0) / n[of[told]] for c, n in zip((c0, c1), sums[2:], strict=True)]
        back = [(1 - np.bincount(of[told], x, minlength=len(at)))[of[told]] for x in own]
        return row(h[told], w[told], [], [*own, *back]), less

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, size = [], [], 0

        def words() -> pa.RecordBatch:
            w, *sums = (np.concatenate(x) for x in zip(*pending, strict=True))
            w, *sums = _merged([w], sums, [])
            return row(np.zeros_like(w), w, sums, [])

        for found in chain(rows_of(batches), [None]):
            if held and (found is None or found[0] != held[0][0]):
                told, less = solve(held)
                yield told
                pending.append(less)
                size += len(less[0])
                held = []
            if pending and (found is None or size > GATHER_WORDS):
                yield words()
                pending, size = [], 0
            held.append(found)

    return run


def pair_counts(train: DataFrame, z: float = Z) -> DataFrame:
    """Rows of ``SUMS``. ``train`` has ``text, toxic``. A history's pairs are counted where its bucket is; a task sends each pair it gathered once."""
    found = train.select("text", "toxic").mapInArrow(_gather_pairs, "bucket int, once binary, more binary, words binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_history(z), SUMS)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms, counts = _Plain(), (Counter(), Counter())

    def out() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n0": pa.array([counts[0][w] for w in words], pa.int64()), "n1": pa.array([counts[1][w] for w in words], pa.int64())})

    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update({forms[w] for w in set(text.split())})
        if len(counts[0]) + len(counts[1]) > GATHER_WORDS:
            yield out()
            counts[0].clear()
            counts[1].clear()
    yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """``word, n0, n1``: the documents of either class that hold the word. ``train`` has ``text, toxic``."""
    return train.mapInArrow(_gather, "word string, n0 long, n1 long").filter("word <> ''").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _told(z: float, share: Column) -> Column:
    """Whether the documents of an expression tell the classes apart, where toxic ones have that share of what it is judged by."""
    expected = (F.col("d0") + F.col("d1")) * share
    return F.abs(F.col("d1") - expected) > z * F.sqrt(expected) + 1


def _single(counts: DataFrame, z: float) -> DataFrame | None:
    """``p0, p1`` of each word beside the columns of ``counts``, and whether it is ``told``: ``d0, d1`` judge it, ``n0, n1`` are its continuation counts. None where a class has no words."""
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "d0", "d1")), *(F.count_if(F.col(f"n{k}") > 0).alias(f"t{k}") for k in (0, 1))).first()
    if not total.n0 or not total.n1:
        return None
    shared = (F.col("n0") + F.col("n1")) / F.lit(total.n0 + total.n1)

    def p(n: str, size: int, types: int) -> Column:
        return F.when(F.col("told"), F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / size + DISCOUNT * types / size * shared).otherwise(shared)

    told = counts.withColumn("told", _told(z, F.lit(total.d1 / (total.d0 + total.d1))))
    return told.withColumns({"p0": p("n0", total.n0, total.t0), "p1": p("n1", total.n1, total.t1)})


def fit(train: DataFrame, z: float = Z, order: int = 1) -> DataFrame:
    """``h, w, llr``: what an expression adds to a text's evidence wherever it stands. ``train`` has ``text, toxic``.

    A word is ``(0, w)``, a history ``(h, 0)`` (the ratio of its backoff weights), a pair ``(h, w)`` (its own ratio less that of its history and word, which count there too). Of order one the ``word`` itself stands beside.
    """
    none = F.lit(0).cast("long")
    if order == 1:
        counts = written(word_counts(train), "toxicity-words").withColumns({"d0": F.col("n0"), "d1": F.col("n1")})
        single = _single(counts, z)
        if single is None:
            return counts.limit(0).select("word", none.alias("h"), none.alias("w"), F.lit(0.0).alias("llr"))
        return single.filter("told").select("word", none.alias("h"), F.xxhash64("word").alias("w"), (F.log("p1") - F.log("p0")).alias("llr"))
    if order != 2:
        raise ValueError("models are of order 1 or 2")
    pairs = written(pair_counts(train, z), "toxicity-pairs")
    counts = pairs.filter("h = 0").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))
    single = _single(written(counts, "toxicity-words"), z)
    if single is None:
        return pairs.limit(0).select("h", "w", F.lit(0.0).alias("llr"))
    back = F.log("b1") - F.log("b0")
    words = single.select("w", "p0", "p1", (F.log("p1") - F.log("p0")).alias("word_llr"))
    ratio = F.log(F.col("o1") + F.col("b1") * F.col("p1")) - F.log(F.col("o0") + F.col("b0") * F.col("p0"))
    told = pairs.filter("h <> 0")
    longer = told.join(words, "w").select("h", "w", (ratio - back - F.col("word_llr")).alias("llr"))
    shorter = told.select("h", none.alias("w"), back.alias("llr")).distinct()
    return single.filter("told").select(none.alias("h"), "w", (F.log("p1") - F.log("p0")).alias("llr")).unionByName(shorter).unionByName(longer)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with its number of words, and one for each of its words, histories and pairs with how often it stands there."""
    row = TaskContext.get().partitionId() << 33
    for rows, words, sizes in _texts(batches, SCORE_WORDS):
        h, w, text = _in_context(words, sizes)
        none = np.zeros_like(w)
        text, h, w = (np.concatenate(x) for x in ((text, text, text), (none, h, h), (w, none, w)))
        order = np.lexsort((w, h, text))
        text, h, w = text[order], h[order], w[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (text[1:] != text[:-1])])[: len(w)])
        times = np.diff(np.append(at, len(w)))
        n, m = len(rows), len(at)
        read = np.bincount(text, minlength=n) // 3
        columns = (row + np.arange(n), [r[0] for r in rows], [r[1] for r in rows], sizes, read, [None] * n, [None] * n, [0] * n), (row + text[at], *([None] * m for _ in range(4)), h[at].view(np.int64), w[at].view(np.int64), times)
        for part in columns:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["row", "doc_id", "key", "n", "words", "h", "w", "times"])
        row += n


class _Units:
    """The units of names, 0 for those unknown; most of these are seen by their low bits."""

    def __init__(self, names: np.ndarray, units: np.ndarray):
        order = np.argsort(names)
        self.names, self.units = names[order], units[order]
        self.mask = np.uint64((1 << max(16, 4 + len(names).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[names & self.mask] = True

    def add(self, names: np.ndarray, to: np.ndarray) -> None:
        at = np.flatnonzero(self.seen[names & self.mask])
        if len(at):
            place = np.minimum(np.searchsorted(self.names, names[at]), len(self.names) - 1)
            to[at] += np.where(self.names[place] == names[at], self.units[place], 0)


def evidence(docs: DataFrame, model: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` (``doc_id, text, key``) as ``doc_id, llr, key, words``: the mean log-likelihood ratio of a word after the one before it, or after the beginning, and the number of words that have one.

    A word adds what it, its history and the pair of both have in ``model``. Both ways split texts and name words by the same helper and sum whole units of ``UNIT``, so they give the same values.
    """
    spark = docs.sparkSession
    model = written(model.select("h", "w", F.round(F.col("llr") / UNIT).cast("long").alias("units")), "toxicity-model")
    docs = docs.select("text", "doc_id", "key")
    known = model.limit(broadcast_words + 1).collect()
    if len(known) <= broadcast_words:
        sent = spark.sparkContext.broadcast(np.array([tuple(r) for r in known], np.int64).reshape(-1, 3))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, w, units = sent.value.T
            h, w = h.astype(np.int64).view(np.uint64), w.astype(np.int64).view(np.uint64)
            word, history, pair = (_Units((h[k] * PAIR ^ w[k]) if both else (h[k] | w[k]), units[k]) for k, both in ((h == 0, False), (w == 0, False), ((h != 0) & (w != 0), True)))
            for rows, words, sizes in _texts(batches, SCORE_WORDS):
                h, w, text = _in_context(words, sizes)
                found = np.zeros(len(w), np.int64)
                word.add(w, found)
                history.add(h, found)
                pair.add(h * PAIR ^ w, found)
                total = np.zeros(len(rows), np.int64)
                told = np.flatnonzero(found)
                np.add.at(total, text[told], found[told])
                llr = total * UNIT / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(llr, pa.float64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(np.bincount(text, minlength=len(rows)), pa.int64())], ["doc_id", "llr", "key", "words"])

        return docs.mapInArrow(score, "doc_id long, llr double, key binary, words long")
    rows = docs.mapInArrow(_tokens, "row long, doc_id long, key binary, n long, words long, h long, w long, times long")
    told = rows.join(model, ["h", "w"], "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("key").alias("key"), F.max("n").alias("n"), F.max("words").alias("words"), F.sum(F.coalesce(F.col("times") * F.col("units"), F.lit(0))).alias("units"))
    return told.select("doc_id", (F.col("units") * UNIT / F.greatest("n", F.lit(1))).alias("llr"), "key", "words")


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve for (evidence, ordinary rows, toxic rows), by Newton's method with a small ridge."""
    x = np.array([b[0] for b in bins])
    n0, n1 = (np.array([b[k] for b in bins], float) for k in (1, 2))
    if not n0.sum() or not n1.sum():
        return 0.0, math.log((n1.sum() + 0.5) / (n0.sum() + 1))
    scale = max(1e-9, float(np.sqrt(((n0 + n1) * x * x).sum() / (n0 + n1).sum())))
    a = np.stack([x / scale, np.ones_like(x)], 1)
    at = np.array([0.0, math.log((n1.sum() + 0.5) / (n0.sum() + 1))])
    ridge = np.diag([0.01, 1e-6])

    def cost(v: np.ndarray) -> float:
        m = a @ v
        return float((n1 * np.logaddexp(0, -m) + n0 * np.logaddexp(0, m)).sum() + 0.5 * v @ ridge @ v)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -500, 500)))
        grad = a.T @ ((n0 + n1) * p - n1) + ridge @ at
        step = np.linalg.solve((a * ((n0 + n1) * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and cost(at - size * step) > cost(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _trained(docs: DataFrame, marks: DataFrame, broadcast_marks: int) -> DataFrame:
    """``text, toxic`` of the rows that ``marks`` has. Where these are too many to go to every task, a filter of their ids keeps most other texts from the join."""
    many = marks.count()
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if many <= broadcast_marks:
        return docs.join(marks.hint("broadcast"), "doc_id").select("text", "toxic")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * many).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(marks, "doc_id", bits))

    @F.arrow_udf("boolean")
    def may_be(slots: pa.Array) -> pa.Array:
        return in_filter(sent.value, slots)

    return docs.filter(may_be(slot("doc_id", bits))).join(marks.hint("merge"), "doc_id").select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", z: float = Z, key: Column | None = None, broadcast_words: int = BROADCAST_WORDS, order: int = ORDER, broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, and ``key`` where one is given: a binary column to carry along. ``labels`` has ``doc_id, toxic``."""
    text_batches(docs.sparkSession)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(None).cast("binary") if key is None else key).alias("key"))
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = written(marks, "toxicity-marks")
    model = fit(_trained(whole, marks, broadcast_marks), z, order)
    scored = written(evidence(whole, model, broadcast_words), "toxicity-evidence")
    bin_of = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.round(F.col("llr") / BIN_WIDTH))).cast("int")
    bins = scored.join(marks, "doc_id").groupBy(bin_of.alias("bin")).agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).orderBy("bin").collect()
    slope, shift = curve([(r.bin * BIN_WIDTH, r.n0, r.n1) for r in bins]) if bins else curve([(0.0, 0, 0)])
    _, base = curve([(0.0, sum(r.n0 for r in bins), sum(r.n1 for r in bins))])
    score = 1 / (1 + F.exp(-F.when(F.col("words") > 0, F.col("llr") * slope + shift).otherwise(base)))
    out = scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), "key").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select("doc_id", "held_out", "score", "predicted", *(["key"] if key is not None else []))
