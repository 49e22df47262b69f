"""Self-join on the Jaccard similarity of word shingles by parity sketches.

A text's shingle set is XOR-hashed into a sketch of words of 64 parity bits. Sizes fall into classes such that linked sets lie in the same class or in neighbouring ones.
For a pair whose smaller set is of a class, a similarity of t allows at most d differing shingles; a sketch of d + s words, each
the parity of its own share of the shingles, then agrees in at least s words. Documents that agree in a word that isn't empty share a bucket.
If all words in which two sketches agree are empty, both have s empty words or more: such sets go on to a sketch with a larger s, where fewer words are empty than have to agree.
After the last of ``SPARE`` empty words count too, so no pair is lost; at 80 and 90 % nearly no set gets there.

Equal sets are one node. In a bucket every node is checked against the bucket's center; in a task's own rows this happens before the shuffle,
so a word that very many documents share sends one row a task. Verified links form components. Where a bucket still holds several
components, blocks of its nodes are compared by the Hamming distance of one-bit-a-shingle sketches, a lower bound
of the symmetric difference, and the pairs within the bound are verified. A pair that shares a bucket is thus verified or in one component already: the components are exact.
Shingles are 64-bit hashes of their words, and sets are named by 64-bit hashes of their shingles.

Null and empty texts, and texts without words, have an empty set and no link. Repeated rows and null ids keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, partitions, slot, text_batches, written
from .components import components

#: Shingles of the documents that a task joins among themselves before it passes words on.
BLOCK_SHINGLES = 4_000_000
#: Words of which the hash is remembered.
KNOWN_WORDS = 1 << 20
#: Centers that the buckets of one group of documents may have.
ORDERS = 16
#: Buckets by which two nodes find out where they meet first.
LOWS = 16
#: Words of a sketch beyond those that can differ, in sixteenths of these, by turn.
SPARE = (1, 4, 16)
#: Bits of the filter for a second reading of texts: 16 for each text wanted, up to 2 MB; beyond, texts are joined.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24
#: Nodes of a bucket that are compared at a time.
BLOCK_NODES = 512

MASK = (1 << 64) - 1
WORDS = "bucket int, keys binary, owners binary, sets binary, doc_id long, n long, node long, bits binary, carried binary"
MEMBERS = "key long, node long, center long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words where there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(1, len(w) - size + 1), np.uint64)
    for k in range(min(size, len(w))):
        out = _mix(out + w[k : k + len(out)] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & MASK))
    return np.unique(out)


def node_of(h: np.ndarray) -> int:
    """The name of a set: a hash of 64 bits."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


class Classes:
    """Size classes for a similarity in percent."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, smaller: int) -> int:
        """The most shingles in which a set of this size can differ from a linked one that is no smaller."""
        return smaller * (100 - self.percent) // self.percent

    def apart(self, k: int) -> int:
        """The most shingles in which linked sets differ of which the smaller is of this class."""
        while len(self.low) <= k + 1:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return self.differ(self.low[k + 1] - 1)


def sketch_keys(h: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of (class, place, word) for both classes in which a set of these shingles may have partners."""
    out, own, mixed = [], classes.of(len(h)), _mix(h)
    for k in (own, own - 1):
        if k < 0:
            continue
        d = classes.apart(k)
        for turn, share in enumerate(SPARE):
            spare = 2 + d * share // 16 if d else 1
            m = d + spare
            # In the first turn places follow the order of the shingles.
            seat = h if not turn else _mix(h + np.uint64(0x9E3779B97F4A7C15 * turn & MASK))
            place = (seat >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            order = np.argsort(place, kind="stable") if turn else slice(None)
            place = place[order]
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            word, at = np.bitwise_xor.reduceat(mixed[order], starts), place[starts]
            enough = m - len(at) < spare
            if not enough and turn == len(SPARE) - 1:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
                word, at = np.concatenate([word, np.zeros(len(empty), np.uint64)]), np.concatenate([at, empty])
            out.append(_mix(_mix(word) + at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * len(SPARE) + turn)))
            if enough:
                break
    return np.concatenate(out)


def bit_sketch(h: np.ndarray) -> bytes:
    """Parity sketch with one bit a shingle; twice as many bits as shingles, rounded up to a power of two."""
    bits = max(64, 1 << int(2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((_mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same shingles with fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def _z(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unz(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _turn(key: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Order of the documents of a bucket, of which the first is its center; one of ``ORDERS`` by the key, so that a large group has many centers."""
    return _mix(ref.astype(np.uint64) ^ (key.astype(np.uint64) % np.uint64(ORDERS)) * np.uint64(0x9E3779B97F4A7C15))


def _runs(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the place of the first row with the same key."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def _sketch(size: int, percent: int, buckets: int):
    names = [x.split(" ")[0] for x in WORDS.split(", ")]
    schema = pa.schema([(x.split(" ")[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]]) for x in WORDS.split(", ")])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], schema.field(c).type) if c in columns else pa.nulls(n, schema.field(c).type) for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = _Hashes(), Classes(percent)
        held, seen, keys, owners, docs = 0, set(), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if docs:
                yield batch(doc_id=[d[0] for d in docs], n=[d[1] for d in docs], node=[d[2] for d in docs], bits=[d[3] for d in docs], carried=[d[4] for d in docs])
            if keys:
                key = np.concatenate(keys)
                own = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                key = key & np.uint64(0xFFFFFFFF)
                order = np.lexsort((_turn(key, own), key, bucket))
                bucket, key, own = bucket[order], key[order], own[order]
                first = _runs(bucket.astype(np.uint64) << np.uint64(32) | key)
                lead = first == np.arange(len(key))
                shared = ~lead
                shared[first[~lead]] = True
                if shared.any():  # members of a task's own groups, as bucket -1
                    yield batch(bucket=[-1], keys=[_z(bucket[shared] << 32 | key[shared].astype(np.int64))], owners=[_z(own[shared])], sets=[_z(own[first[shared]])])
                cuts = np.flatnonzero(np.concatenate([[True], bucket[lead][1:] != bucket[lead][:-1]]))
                for b, k, o in zip(bucket[lead][cuts], np.split(key[lead], cuts[1:]), np.split(own[lead], cuts[1:]), strict=True):
                    sets, at = np.unique(o, return_inverse=True)
                    yield batch(bucket=[int(b)], keys=[_z(np.diff(k.astype(np.uint32), prepend=np.uint32(0)))], owners=[_z(at.astype(np.uint32))], sets=[_z(sets)])
            seen.clear()
            keys.clear()
            owners.clear()
            docs.clear()

        for b in batches:
            for doc_id, text, carried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = shingles(text, size, hashes) if text else np.zeros(0, np.uint64)
                mark = node_of(h)
                docs.append((doc_id, len(h), mark, bit_sketch(h) if len(h) else b"", carried))
                if len(h) and mark not in seen:
                    seen.add(mark)
                    keys.append(sketch_keys(h, classes))
                    owners.append(mark)
                    held += len(h)
            if held > BLOCK_SHINGLES:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _members(table: pa.Table) -> pa.Table:
    """A bucket: the rows of every key that two sets or more have."""
    bucket = table.column("bucket")[0].as_py()
    key, own = [], []
    for k, o, s in zip(*(table.column(c).to_pylist() for c in ("keys", "owners", "sets")), strict=True):
        key.append(np.cumsum(_unz(k, np.uint32), dtype=np.uint32).astype(np.int64))
        own.append(_unz(s, np.int64)[_unz(o, np.uint32)])
    key, own = np.concatenate(key), np.concatenate(own)
    order = np.lexsort((own, _turn(key, own), key))
    key, own = key[order], own[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])  # equal sets of several tasks are one
    key, own = key[new], own[new]
    first = _runs(key)
    many = first != np.arange(len(key))
    many[first[many]] = True
    return pa.table({"key": bucket << 32 | key[many], "node": own[many], "center": own[first[many]]})


def _own_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "node", "center"), (_unz(c, np.int64) for c in columns), strict=True)))


def _sets(docs: DataFrame, nodes: DataFrame, size: int, most_bits: int = MOST_BITS) -> DataFrame:
    """``node, shingles`` of the ``node, doc_id`` wanted, by a second reading of the texts.

    A filter over the wanted ids is broadcast, so tasks work on few texts and no text is shuffled; what else passes is dropped by the join.
    Where the filter would outgrow ``most_bits``, the texts of the wanted ids are found by a join.
    """
    wanted = nodes.select("doc_id").distinct()
    bits = max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length())
    if bits > most_bits:
        ids = wanted.select(F.col("doc_id").alias("wanted_id"))
        texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select(F.lit(0).cast("long").alias("slot"), "text")
        table = np.full(1, MASK, np.uint64)
    else:
        texts, table = docs.select(slot("doc_id", bits).alias("slot"), "text"), bit_filter(wanted, "doc_id", bits)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = _Hashes(), sent.value
        for batch in batches:
            sets = [shingles(t, size, hashes) for t in batch.column(1).filter(in_filter(held, batch.column(0))).to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(h) for h in sets], pa.int64()), "shingles": pa.array([h.tobytes() for h in sets], pa.binary())})

    again = texts.mapInArrow(run, "node long, shingles binary")
    return again.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _within(percent: int):
    """Pairs whose sketches don't lie further apart than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, m, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "n")), strict=True):
                size = min(len(a), len(b))
                keep.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= min(m, n) * (100 - percent) // percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the ``u, v`` pairs that the sketches don't rule out."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("bits").alias(y), F.col("n").alias(z)) for x, y, z in (("u", "a", "m"), ("v", "b", "n")))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", "m", "n").mapInArrow(_within(percent), "u long, v long")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the ``u, v`` pairs whose sets are similar enough."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = written(_sets(docs, nodes.select("node", "doc_id").join(ends, "node", "left_semi"), size), "sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_linked(percent), "u long, v long"), "links")


def _near(percent: int):
    """Pairs of nodes of two blocks of a bucket that lie in different components and within the sketches' bound."""

    def run(table: pa.Table) -> pa.Table:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = table.to_pylist()
        size = min(len(r["bits"]) for r in rows)
        left, right = ([r for r in rows if r["side"] in (s, 2)] for s in (0, 1))
        if left and right:
            node, comp, n = (np.array([r[c] for r in right], np.int64) for c in ("node", "component", "n"))
            key, lows = rows[0]["key"], [set(r["lows"]) for r in right]
            bits = np.stack([folded(r["bits"], size) for r in right])
            for r in left:
                apart = np.bitwise_count(bits ^ folded(r["bits"], size)).sum(axis=1, dtype=np.int64)
                hit = (comp != r["component"]) & (apart <= np.minimum(n, r["n"]) * (100 - percent) // percent) & ((node > r["node"]) | (r["side"] != 2))
                mine = set(r["lows"])
                hit = np.array([j for j in np.flatnonzero(hit).tolist() if min(mine & lows[j], default=key) == key], np.int64)  # told in one bucket
                u.append(np.minimum(node[hit], r["node"]))
                v.append(np.maximum(node[hit], r["node"]))
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs still to verify, in buckets that hold several components."""
    told = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), *marks)
    mixed = mixed.filter("low < high and size > 2")  # the one pair of two nodes has been looked at
    # Buckets of the same nodes are one.
    mixed = mixed.groupBy("size", "mark0", "mark1").agg(F.min("key").alias("key"))
    # Members of a bucket fall into blocks by hash; each pair of blocks is a group of its own.
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    told = written(told.join(mixed.select("key", blocks.alias("blocks")), "key"), "mixed")
    # A pair that shares several buckets is told in the first that is among the lowest of both.
    lows = told.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWS).alias("lows"))
    dealt = told.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("side", F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "side", "node", "component").join(nodes.select("node", "n", "bits").join(lows, "node"), "node")
    return dealt.groupBy("key", "x", "y").applyInArrow(_near(percent), "u long, v long").distinct()


@dataclass
class _Found:
    """What the sketches gave: ``named`` has ``doc_id, key, n, node`` of each row, ``nodes`` the distinct sets, ``pairs`` those with the centers of buckets, ``members`` the ``key, node`` of buckets."""

    whole: DataFrame
    named: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    members: DataFrame


def _found(docs: DataFrame, size: int, percent: int, text: str, doc_id: str, key: Column | None) -> _Found:
    spark = docs.sparkSession
    text_batches(spark)
    n = partitions(spark)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(None).cast("binary") if key is None else key).alias("carried"))
    table = written(whole.mapInArrow(_sketch(size, percent, n), WORDS), "parity-words")
    named = table.filter("bucket is null").select("doc_id", F.col("carried").alias("key"), "n", "node")
    nodes = table.filter("bucket is null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    shared = table.filter("bucket >= 0").select("bucket", "keys", "owners", "sets").groupBy("bucket").applyInArrow(_members, MEMBERS)
    own = table.filter("bucket = -1").select("keys", "owners", "sets").mapInArrow(_own_members, MEMBERS)
    found = written(shared.unionByName(own), "members")
    pairs = found.filter("node <> center").select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v")).distinct()
    members = found.select("key", "node").unionByName(found.select("key", F.col("center").alias("node"))).distinct()
    return _Found(whole, named, nodes, written(_bounded(pairs, nodes, percent), "pairs"), members)


def _labels(f: _Found, size: int, percent: int) -> DataFrame:
    """``node, component`` of the sets that have links."""
    links = _verified(f.whole, f.pairs, f.nodes, size, percent)
    more = written(_rest(f.members, components(links), f.nodes, percent), "rest")
    return components(links.unionByName(_verified(f.whole, more, f.nodes, size, percent)))


def ngram_rows(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", key: Column | None = None) -> DataFrame:
    """``doc_id, key, n, node, component`` for every row: its number of shingles, the name of their set and the smallest name that links reach; ``key`` is a binary column to carry along."""
    f = _found(docs, size, percent, text, doc_id, key)
    return f.named.join(_labels(f, size, percent), "node", "left").select("doc_id", "key", "n", "node", F.coalesce("component", "node").alias("component"))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; a component's id is its smallest ``doc_id``."""
    f = _found(docs, size, percent, text, doc_id, None)
    told = f.nodes.select("node", "doc_id").join(_labels(f, size, percent), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    # Distinct sets look up their component's smallest id, rows the id of their set. Both tables are written, so that they are broadcast by their size or joined by shuffles in which skewed parts are split.
    least = told.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("component", F.col("component_id").alias("least"))
    ids = written(told.join(written(least, "least"), "component", "left").select("node", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")), "ids")
    out = f.named.join(ids, "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_links(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Membership and links in full. ``doc_id, n_shingles, class_id, n_links`` for every row: rows of one class have equal sets, and ``n_links`` counts the other rows, copies included, that it is linked to.
    ``u, v`` are the linked pairs of classes, each once, with ``u < v``.

    All sets of a bucket are compared, a pair of blocks at a time, not only those of different components; so work and output grow with the links between different sets, while copies aren't expanded.
    """
    f = _found(docs, size, percent, text, doc_id, None)
    apart = docs.sparkSession.createDataFrame([], "node long, component long")
    pairs = f.pairs.unionByName(_rest(f.members, apart, f.nodes, percent)).distinct()
    links = _verified(f.whole, written(pairs, "all-pairs"), f.nodes, size, percent).distinct()
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    others = ends.join(f.nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    counts = f.nodes.select("node", "copies").join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    rows = f.named.join(written(counts, "counts"), "node")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links")), links
