from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestar.llm.sharding import ShardStore, sharded

SCHEMA = "doc_id long, text string, shard string"


def docs(spark, low, high):
    return spark.createDataFrame([(i, None if i % 50 == 0 else "x" * (i % 97), "clash") for i in range(low, high)], SCHEMA)


def test_every_document_is_in_one_shard(spark, tmp_path):
    df = docs(spark, 0, 500).unionAll(docs(spark, 0, 3))
    out = sharded(df, str(tmp_path), target_bytes=5000, arrival_rows=10)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(500), 0, 1, 2])
    shards = {(r.shard, r.shard_rows, r.shard_bytes) for r in got}
    assert sum(n for _, n, _ in shards) == 503 and len(shards) < 15
    assert max(b for *_, b in shards) <= 5000 + 10 * 97


def test_versions_and_conflicts(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), 4000)
    assert store.version() == 0 and store.read(docs(spark, 0, 1).schema).count() == 0
    store.append(docs(spark, 0, 100), 5)
    first = store.version()
    many = store.manifest().count()
    store.append(docs(spark, 100, 200), 5)
    store.compact(docs(spark, 0, 1).schema)
    store.target = 9000
    last = store.compact(docs(spark, 0, 1).schema)
    assert last > first + 1 and store.manifest().count() < many
    assert store.read(docs(spark, 0, 1).schema, first).count() == 100
    assert sorted(r.doc_id for r in store.read(docs(spark, 0, 1).schema).collect()) == list(range(200))
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(), first)
    assert not [p for p in (tmp_path / "manifests").iterdir() if p.name == f"v{last + 1:08d}" or p.name.startswith("p")]


def test_empty(spark, tmp_path):
    assert sharded(docs(spark, 0, 5).limit(0), str(tmp_path)).collect() == []


def test_columns_with_the_stores_own_names(spark, tmp_path):
    names = "merge_path merge_run shard_path run path shard rows bytes at its tier part _metadata"
    df = docs(spark, 0, 40).drop("shard").select("*", *(F.lit(c).alias(c) for c in names.split()), F.lit(7).alias("Run_"))
    assert sharded(df, str(tmp_path), target_bytes=2000, arrival_rows=3).count() == 40
    kept = ShardStore(spark, str(tmp_path)).read(df.schema, path="where")
    assert kept.drop("where").exceptAll(df).count() == 0 and kept.count() == 40


def test_null_ids_and_long_texts(spark, tmp_path):
    rows = [(None, "x" * 50_000, "a"), (None, "x" * 50_000, "a"), (None, None, None), (2**60 + 1, "", "b")]
    out = sharded(spark.createDataFrame(rows, SCHEMA), str(tmp_path), target_bytes=9000, arrival_rows=1).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(["None"] * 3 + [str(2**60 + 1)])
    assert sum({r.shard: r.shard_bytes for r in out}.values()) == 100_000


def test_of_two_writers_one_commits(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), 4000)
    store.append(docs(spark, 0, 10))
    other = ShardStore(spark, str(tmp_path), 4000)
    before = store.version()
    with ThreadPoolExecutor(2) as pool:
        done = [pool.submit(s.commit, s.manifest(before), before) for s in (store, other)]
        failed = [d.exception() for d in done]
    assert sum(e is None for e in failed) == 1 and sum(isinstance(e, RuntimeError) for e in failed) == 1
