"""Approximate neighbour graphs and exact search by multi-index hashing, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search
from lodestar.operators.multi_index import MultiIndex
from lodestar.operators.neighbours import approximate_knn, recall


def signed(x):
    return x - 2**64 if x >> 63 else x


def codes_of(spark, n, limbs, centers=0, seed=1):
    rng = random.Random(seed)
    middle = [[rng.getrandbits(64) for _ in range(limbs)] for _ in range(centers)]
    rows = []
    for i in range(n):
        c = list(rng.choice(middle)) if centers else [rng.getrandbits(64) for _ in range(limbs)]
        for _ in range(rng.randrange(12 * limbs) if centers else 0):
            b = rng.randrange(64 * limbs)
            c[b // 64] ^= 1 << b % 64
        rows.append((i * 3, *map(signed, c)))
    rows += [(-5, *[None] * limbs)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} long" for k in range(limbs)))


def exact(codes, k, heads=None):
    return search.knn(codes, codes if heads is None else codes.filter(heads), k + 1).filter("query_id <> id").drop("rank")


@pytest.mark.parametrize("n,limbs,centers", [(1500, 1, 20), (900, 3, 0)])
def test_most_neighbours_are_found(spark, n, limbs, centers):
    codes, k = codes_of(spark, n, limbs, centers), 10
    got = approximate_knn(codes, k, block=64)
    lists = {}
    for r in got.collect():
        lists.setdefault(r.head, []).append((r.dist, r.tail))
    own = {r[0]: r[1:] for r in codes.collect() if r[1] is not None}
    assert set(lists) == set(own)
    for head, near in lists.items():
        assert len({t for _, t in near} - {head}) == len(near) == k
        assert all(d == sum(((a ^ b) % 2**64).bit_count() for a, b in zip(own[head], own[t], strict=True)) for d, t in near)
    r = recall(got, exact(codes, k).withColumn("n", F.expr(f"row_number() over (partition by query_id order by dist, id)")).filter(f"n <= {k}")).first()
    assert r.queries == n and r.recall >= (0.95 if centers else 0.9)


def test_recall_holds_while_buckets_get_narrow(spark):
    """Many buckets for their rows, as a large table has them: two near rows seldom agree in all of a table's bits."""
    codes = codes_of(spark, 4000, 1).cache()
    heads = codes.filter("id % 60 = 0")
    exact_ = search.knn(codes, heads, 6).filter("query_id <> id").withColumn("n", F.expr("row_number() over (partition by query_id order by dist, id)")).filter("n <= 5")
    assert recall(approximate_knn(codes, 5, held=10, block=16, rounds=2), exact_).first().recall >= 0.65


def test_same_graph_however_rows_are_stored(spark):
    codes = codes_of(spark, 300, 1, 5)
    a, b = (sorted(map(tuple, approximate_knn(c, 5, block=32).collect())) for c in (codes, codes.repartition(7).orderBy(F.desc("id"))))
    assert a == b and len(a) == 1500


def test_few_rows(spark):
    codes = codes_of(spark, 3, 1)
    assert sorted((r.head, r.tail) for r in approximate_knn(codes, 10).collect()) == [(0, 3), (0, 6), (3, 0), (3, 6), (6, 0), (6, 3)]
    assert approximate_knn(codes.filter("id < 0"), 10).collect() == []


@pytest.mark.parametrize("n,limbs,centers,k", [(3000, 1, 300, 5), (1200, 2, 60, 3), (400, 1, 0, 10), (7, 1, 0, 10)])
def test_multi_index_is_exact(spark, tmp_path, n, limbs, centers, k):
    codes = codes_of(spark, n, limbs, centers)
    MultiIndex.build(codes, f"{tmp_path}/index")
    index = MultiIndex.open(spark, f"{tmp_path}/index")
    assert index.rows == n and sum(index.widths) == 64 * limbs
    queries = codes.filter("id % 60 = 0 or id < 0")
    got = sorted((r.query_id, r.id, r.dist, r.rank) for r in index.topk(queries, k).collect())
    assert got == sorted((r.query_id, r.id, r.dist, r.rank) for r in search.knn(codes, queries, k).collect())


def test_a_near_search_reads_part_of_the_index(spark, tmp_path):
    codes = codes_of(spark, 4000, 1, 400)
    index = MultiIndex.build(codes, f"{tmp_path}/index")
    one = codes.filter("id = 30").select(F.col("id").alias("query_id"), "c0", F.col("c0").alias("q0"))
    for radius in (0, 1):
        read = index.read(spark, index.lookups(one, radius))
        files = lambda df: df.select("_metadata.file_path").distinct().count()
        assert 0 < files(read) < files(index.table(spark)) / (4 if radius else 10)
        assert read.count() < index.table(spark).count() / (4 if radius else 10)


def test_a_single_file_of_codes_is_searched_by_many_tasks(spark):
    one = codes_of(spark, 600, 2).coalesce(1)
    found = search.knn(one, one.filter("id % 30 = 0"), 7)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    own = {r[0]: r[1:] for r in one.collect() if r[1] is not None}
    apart = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(own[a], own[b], strict=True))
    want = {(q, i, d) for q in own if q % 30 == 0 for d, i in sorted((apart(q, i), i) for i in own)[:7]}
    assert {(r.query_id, r.id, r.dist) for r in found.collect()} == want
