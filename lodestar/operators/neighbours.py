"""An approximate k-NN graph of codes by neighbour refinement: near ones are found among a row's neighbours' neighbours.

It begins with buckets: rows that agree in sampled bits of their codes are compared with each other, in blocks of a bounded size. Then come rounds of refinement. In each, the rows of a point's list meet
at that point with a bounded sample of the rows that have it in theirs, and those that met for the first time are compared; a pair goes on only if it is nearer than the furthest that either end has, and lists are
cut to k again. Work and shuffles of a round grow with rows times k; no query passes the driver, which sees one count a round. The lists are a table, written anew each round.

Rows without a code have no neighbours and are none. Ties go by id. The result depends on ids and codes only, not on how rows are partitioned.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch, groups
from .search import limbs

#: Rows of a bucket's block; share of changed list entries under which refinement ends.
BLOCK, SETTLED = 256, 0.001

EDGES = "head long, tail long, dist int, code array<long>, there array<long>, fresh boolean"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _edges(head: np.ndarray, tail: np.ndarray, dist: np.ndarray, code: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    width = code.shape[1]
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(c).ravel())) for c in (code, there)]
    return pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), pa.array(dist.astype(np.int32)), *lists, pa.array(np.ones(len(head), bool))], names=["head", "tail", "dist", "code", "there", "fresh"])


def _apart(codes: np.ndarray) -> np.ndarray:
    """Bits in which each row differs from each other one."""
    out = np.zeros((len(codes), len(codes)), np.int32)
    for limb in codes.T:
        out += np.bitwise_count((limb[:, None] ^ limb[None]).view(np.uint64))
    return out


def _met(k: int):
    """The nearest of each row inside its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            block, ids, codes = table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2))
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                apart = _apart(codes[a:b])
                np.fill_diagonal(apart, np.iinfo(np.int32).max)
                order = np.lexsort((np.broadcast_to(ids[a:b], apart.shape), apart), axis=1)[:, : min(k, b - a - 1)]
                head = np.repeat(np.arange(b - a), order.shape[1])
                tail = order.ravel()
                yield _edges(ids[a:b][head], ids[a:b][tail], apart[head, tail], codes[a:b][head], codes[a:b][tail])

    return run


def _shortened(k: int):
    """The ``k`` nearest of each head, sorted by head, distance, tail and ``fresh``: an old entry comes before the same one found again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            head, tail = table.column("head").to_numpy(), table.column("tail").to_numpy()
            new = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
            rows = np.flatnonzero(new)
            own = head[rows]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
            yield from table.take(pa.array(rows[rank < k])).to_batches()

    return run


def _local(most: int):
    """Pairs of rows that meet at a point, one of them for the first time, if they are nearer than the furthest that an end has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            at, ids, far, fresh = (table.column(i).to_numpy() for i in range(4))
            codes = _matrix(table.column(4))
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            size = np.diff(np.append(start, len(at)))
            for first in range(1, most):
                # The pairs of rows that stand this far from each other in a group.
                a = np.arange(len(at) - first)
                a = a[at[a] == at[a + first]]
                b = a + first
                keep = (fresh[a] | fresh[b]) & (ids[a] != ids[b])
                a, b = a[keep], b[keep]
                if not len(a):
                    if (size <= first).all():
                        break
                    continue
                dist = np.bitwise_count((codes[a] ^ codes[b]).view(np.uint64)).sum(axis=1, dtype=np.int32)
                for x, y in ((a, b), (b, a)):
                    near = dist < far[x]
                    if near.any():
                        yield _edges(ids[x[near]], ids[y[near]], dist[near], codes[x[near]], codes[y[near]])

    return run


def approximate_knn(codes: DataFrame, k: int = 15, tables: int | None = None, rounds: int = 8, held: int | None = None, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """``head, tail, dist``: about the ``k`` nearest rows of each row of ``codes`` (``id`` and limbs, ids distinct), without itself.

    Lists of ``held`` rows (three times ``k``) are refined and cut at the end: the less structure the codes have, the longer lists have to be.
    Buckets keep their size while rows grow, so two near rows agree in all of a table's bits the more seldom the more bits it has: there are three tables for each bit (four at least), and each gives its share of first entries.
    """
    spark, columns = codes.sparkSession, limbs(codes)
    scratch = Scratch(spark, "neighbours")
    points = scratch.write(codes.filter(F.col(columns[0]).isNotNull()).select("id", F.array(*columns).alias("code")), "points")
    n = points.count()
    held = 3 * k if held is None else max(k, held)

    # Sampled bits of each table, as many as leave a bucket half a block on average.
    width, chosen = max(1, math.ceil(math.log2(max(2, 2 * n / block)))), random.Random(seed)
    tables = max(4, 3 * width) if tables is None else tables
    keys = []
    for _ in range(tables):
        bits = chosen.sample(range(64 * len(columns)), min(width, 63))
        parts = [F.call_function("shiftleft", F.call_function("shiftright", F.get("code", F.lit(b // 64)), F.lit(b % 64)).bitwiseAND(F.lit(1)), F.lit(j)) for j, b in enumerate(bits)]
        keys.append(sum(parts[1:], parts[0]))
    dealt = points.select("id", "code", F.posexplode(F.array(*keys)).alias("t", "key"))
    counts = scratch.write(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")), "buckets")
    parts = F.ceil(F.col("size") / block)
    blocks = dealt.join(counts, ["t", "key"]).select(F.xxhash64("t", "key", F.pmod(F.xxhash64(F.lit(seed), "t", "id"), parts)).alias("block"), "id", "code")
    found = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_met(max(1, -(-4 * held // tables))), EDGES)

    def cut(edges: DataFrame) -> DataFrame:
        return scratch.write(edges.repartition("head").sortWithinPartitions("head", "dist", "tail", "fresh").mapInArrow(_shortened(held), EDGES), "lists")

    lists = cut(found)
    for turn in range(rounds):
        far = lists.groupBy("head").agg(F.when(F.count(F.lit(1)) >= held, F.max("dist")).otherwise(F.lit(2**31 - 1)).cast("int").alias("far"))
        both = lists.join(far, "head").join(far.select(F.col("head").alias("tail"), F.col("far").alias("far_there")), "tail", "left")
        forward = both.select(F.col("head").alias("at"), F.col("tail").alias("id"), F.coalesce("far_there", F.lit(2**31 - 1)).alias("far"), "fresh", F.col("there").alias("code"))
        order = Window.partitionBy("at").orderBy(F.xxhash64(F.lit(turn), "id"), "id")
        back = both.select(F.col("tail").alias("at"), F.col("head").alias("id"), "far", "fresh", "code").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= held).drop("n")
        met = forward.unionByName(back).repartition("at").sortWithinPartitions("at", "id").mapInArrow(_local(2 * held), EDGES)
        lists = cut(lists.withColumn("fresh", F.lit(False)).unionByName(met))
        if lists.filter("fresh").count() <= SETTLED * n * held:
            break
    rank = F.row_number().over(Window.partitionBy("head").orderBy("dist", "tail"))
    out = scratch.write(lists.select("head", "tail", "dist").withColumn("n", rank).filter(F.col("n") <= k).drop("n"), "nearest")
    scratch.keep("nearest")
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``queries, recall``: the share of ``exact`` (``query_id, id, dist``) lists that ``found`` (``head, tail, dist``) has; one as near as the furthest exact one counts, whichever it is."""
    want = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.max("dist").alias("far"))
    got = found.join(want, F.col("head") == F.col("query_id")).filter(F.col("dist") <= F.col("far")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    all_ = want.join(got, "query_id", "left")
    return all_.agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least("k", F.coalesce("hits", F.lit(0)))) / F.sum("k")).alias("recall"))
