"""Collocations: phrases whose words stand together more often than apart, counted by suffix automata of shards.

Each task takes its texts as shards of a bounded number of words and builds, for each language, the generalised suffix automaton of the pieces down to a bounded depth. Its states are classes of strings with the same end positions,
and its suffix links form the tree of reversed contexts: the node of a string is below that of the string without its first word. So a shard's automaton is built level by level from the word at each end position,
by sorting (node, word before); a node has its link, its first word and the number of its end positions. Strings with their counts are enumerated from the nodes and summed over all shards.

Level by level over all shards too: strings of three words or more are counted only where both strings of one word less are frequent everywhere, so rare ones are never shuffled. What is frequent is told
to the tasks by a bit filter of a bounded size: it lets some rare ones pass, which the sum then rejects, and never holds a frequent one back.

A candidate is dropped if a longer one holds it and has at least half its count. Of the longer candidates that hold it, one with one word more has the most occurrences, and is found from its own string by two links: without the first word (the suffix link), without the last.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, and pieces into words at spaces and tabs. A null text counts as empty, a null language as ``und``; repeated rows count each time. Other columns aren't read. A language without candidates has no rows.
Scores are exact while counts stay below 10**15. Ties in rank go by count, then by the bytes of the phrase. Memory of a task is bounded by the words of a shard and one text's bytes; a long text is worked through in parts, with the words before a part as context.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, written

#: Words of a shard, and bytes of a text that are split at once.
SHARD_WORDS, SPLIT_BYTES = 1 << 20, 1 << 20
#: Bits of the filter of frequent strings: 16 for each, up to 2 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24

#: A string's key is its language, a line feed, which no string holds, and the string: one short column to hash and shuffle.
COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64())])

#: A-Z to a-z, a tab to a space, and all that ends a piece to a full stop.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, a full stop where a piece ends, those of a megabyte at a time."""
    data = text.translate(_PLAIN).replace(b".", b" . ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SPLIT_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
    yield [b"."]


class Shard:
    """Words of one language, a full stop where a piece ends."""

    def __init__(self, context: pa.Array | None = None) -> None:
        # Begins with a full stop, so that its number is 0, and the words before, which end no string here.
        self.parts = [pa.array([b"."], pa.binary()), *([] if context is None else [context])]
        self.context = self.size = sum(map(len, self.parts))

    def add(self, words: list[bytes]) -> None:
        self.parts.append(pa.array(words, pa.binary()))
        self.size += len(words)

    def after(self, depth: int) -> Shard:
        """An empty shard, with the words that stand before whatever comes next as context that isn't counted again. To be asked before ``levels``, which gives up the words."""
        first, size = len(self.parts), 0
        while first and size < depth:
            first -= 1
            size += len(self.parts[first])
        return Shard(pa.array(pa.concat_arrays(self.parts[first:])[-depth:].to_pylist(), pa.binary()) if depth else None)

    def levels(self, depth: int, frequent: np.ndarray | None, lang: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """Level 0 has the empty string, level d the strings of d words: the strings and how often each ends somewhere. With ``frequent``, the last level is the only one, and holds no string whose own parts of one word less aren't frequent."""
        encoded = pa.concat_arrays(self.parts).dictionary_encode()
        self.parts = []
        vocabulary = encoded.dictionary.cast(pa.string())
        ids = encoded.indices.to_numpy().astype(np.int64)
        ends = np.flatnonzero(ids)
        if frequent is None:
            own = ids[ends[ends >= self.context]]
            yield 0, pa.array([""]), np.array([len(own)])
            if depth:
                count = np.bincount(own, minlength=len(vocabulary))
                keep = np.flatnonzero(count)
                yield 1, vocabulary.take(pa.array(keep)), count[keep]
        node, strings = ids, vocabulary
        bits = None if frequent is None else _word_bits(vocabulary, 1) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), _seed(0)))
        for d in range(2, depth + 1):
            ends = ends[ends >= d - 1]
            ends = ends[ids[ends - d + 1] != 0]
            if d == depth:
                ends = ends[ends >= self.context]
                if frequent is not None:
                    told = in_bits(frequent, bits)
                    ends = ends[told[node[ends]] & told[node[ends - 1]]]
            if not len(ends):
                return
            key = node[ends] * len(vocabulary) + ids[ends - d + 1]
            if d < depth:
                key, number, count = np.unique(key, return_inverse=True, return_counts=True)
                if frequent is None:
                    count = np.bincount(number[ends >= self.context], minlength=len(key))
                node = np.zeros(len(ids), np.int64)
                node[ends] = number
            else:
                key, count = np.unique(key, return_counts=True)
            link, first = key // len(vocabulary), key % len(vocabulary)
            strings = pc.binary_join_element_wise(vocabulary.take(pa.array(first)), strings.take(pa.array(link)), " ")
            if frequent is None or d == depth:
                keep = np.flatnonzero(count)
                yield d, strings if len(keep) == len(count) else strings.take(pa.array(keep)), count[keep]
            elif d < depth:
                bits = bits[link] ^ _word_bits(vocabulary, d)[first]


def _seed(place: int) -> int:
    """The seed of the hash of a word at a place from a string's end; at place 0, of the language."""
    return xxhash.xxh64_intdigest(str(place).encode(), 42)


def _word_bits(vocabulary: pa.Array, place: int) -> np.ndarray:
    seed, digest = _seed(place), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary))


def phrase_bits(words: int) -> Column:
    """The same hash of ``lang, phrase`` in a plan: that of the language and of each word at its place from the end, by exclusive or."""
    out = F.xxhash64(F.lit("0"), F.col("lang"))
    for place in range(1, words + 1):
        out = out.bitwiseXOR(F.xxhash64(F.lit(str(place)), F.split("phrase", " ")[words - place]))
    return out


def in_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.int64) % (len(table) * 64)
    return table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def phrase_counts(docs: DataFrame, depth: int, frequent: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, words, phrase, n``: how often each string of up to ``depth`` words occurs; the empty string (0 words) as often as there are words. With ``frequent``, only strings of ``depth`` words."""

    def told(shards: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards.items():
            begin = pa.scalar(f"{lang}\n")
            for _, strings, count in shard.levels(depth, frequent, lang):
                for i in range(0, len(count), 1 << 16):
                    some = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(begin, strings[some], ""), pa.array(count[some], pa.int64())], schema=COUNTS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: defaultdict[str, Shard] = defaultdict(Shard)
        total = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, lang in enumerate(batch.column(0).to_pylist()):
                for words in _words(texts[i].as_py() or b""):
                    shards[lang].add(words)
                    total += len(words)
                    if total >= shard_words:
                        rest, total = shards[lang].after(depth - 1), 0
                        yield from told(shards)
                        shards.clear()
                        shards[lang] = rest
        yield from told(shards)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(count, "key string, n long")
    summed = rows.groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    return summed.select(lang.alias("lang"), words.alias("words"), phrase.alias("phrase"), "n")


def _filter(frequent: DataFrame, words: int) -> np.ndarray:
    bits = LEAST_BITS
    wanted = frequent.count()
    while bits < min(MOST_BITS, 16 * wanted):
        bits *= 2
    return bit_filter(frequent.select(phrase_bits(words).alias("bits")), "bits", bits, hashed=True)


def frequent_phrases(docs: DataFrame, max_words: int = 3, least: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, words, phrase, n`` of all strings of up to ``max_words`` words that occur ``least`` times, and for each language the number of its words (0 words). The table is written."""
    out = level = written(phrase_counts(docs, min(2, max_words), None, shard_words).filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")
    for d in range(3, max_words + 1):
        shorter = level.filter(F.col("words") == d - 1)
        level = written(phrase_counts(docs, d, _filter(shorter, d - 1), shard_words).filter(F.col("n") >= least), "phrases")
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, percent: int = 50, most: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each language of 2 to ``max_words`` words and ``least`` occurrences, without those that a longer one with ``percent`` of their occurrences holds.

    The score is ``floor(1000000 * a * a / (l * r))`` with the counts of both parts of the phrase, for the cut with the lowest score (the first of these).
    """
    strings = frequent_phrases(docs, max_words, least, shard_words)
    counts = strings.select("lang", "phrase", "n")
    candidates = strings.filter("words >= 2").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # Both sides fit 38 digits, and the quotient of whole numbers is exact.
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(30,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    links = candidates.filter("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice("w", F.lit(2), F.size("w")), " "), F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "))).alias("phrase"), "n")
    longer = links.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    sizes = strings.filter("words = 0").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "best.l", "best.r", "n", "best.score")
