"""Updates in one commit, and ingest with its keys in a table: repeated after crashes, in proportion to the batch."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import update_run as module
from lodestar.operators.update_run import Index, run_update
from lodestar.sources.versions import Conflict, Versions
from lodestar.streaming.known import KnownKeys, ingest_known


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.latest() == (-1, {})
    assert v.commit(-1, {"a": 1}) == 0 and v.latest() == (0, {"a": 1})
    with pytest.raises(Conflict):
        v.commit(-1, {"a": 2})
    # A version that a crash has torn doesn't count, and its number isn't used again.
    (tmp_path / "versions" / "00000001").write_text('{"a": 3')
    assert v.latest() == (0, {"a": 1})
    assert v.commit(0, {"a": 4}) == 2 and v.latest() == (2, {"a": 4})
    for name in ("x", "y"):
        (tmp_path / "t" / name).mkdir(parents=True)
    assert v.clean("t", {"y"}) == ["x"] and os.listdir(tmp_path / "t") == ["y"]


def files_of(spark, spec):
    return spark.createDataFrame([(s, f, float(t), n) for s, f, t, n in spec], "source string, stem string, mtime double, rows long")


def rows_of(spark, spec):
    table = spark.createDataFrame([(s, f, i, f"text {s} {f} {i}") for s, f, _, n in spec for i in range(n)], "source string, stem string, local_idx long, text string")
    asked = []

    def rows(wanted):
        asked.append(sorted(map(tuple, wanted.collect())))
        return table.join(wanted, ["source", "stem"])

    return rows, asked


A = [("a b", "f1", 1, 30), ("a b", "f2", 1, 20), ("c", "f1", 1, 10), ("c", "f0", 1, 0)]
B = [*A, ("c", "f2", 5, 45), ("d", "f9", 5, 5)]


def tree(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)


@pytest.mark.parametrize("step", ["commit", "encoded"])
def test_a_run_that_crashes_changes_nothing(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "index")
    rows, asked = rows_of(spark, B)
    assert run_update(spark, root, files_of(spark, A), rows, 50) == {"a b": "incremental", "c": "incremental"}
    at = Index(spark, root)
    before, codes = sorted(map(tuple, at.files().collect())), sorted(map(tuple, at.codes().collect()))
    assert len(codes) == 60

    def crash(*_, **__):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(*{"commit": (Versions, "commit"), "encoded": (module, "encoded")}[step], crash)
        with pytest.raises(RuntimeError, match="crash"):
            run_update(spark, root, files_of(spark, B), rows, 50)
    assert sorted(map(tuple, at.files().collect())) == before and sorted(map(tuple, at.codes().collect())) == codes
    assert run_update(spark, root, files_of(spark, B), rows, 50) == {"a b": "none", "c": "incremental", "d": "incremental"}
    assert asked[-1] == [("c", "f2"), ("d", "f9")]
    assert {(r.source, r.stem): (r.chunk_id, r.global_start, r.global_end) for r in at.files().collect()} == {("a b", "f1"): (0, 0, 29), ("a b", "f2"): (0, 30, 49), ("c", "f0"): (0, 0, -1), ("c", "f1"): (0, 0, 9), ("c", "f2"): (1, 10, 54), ("d", "f9"): (0, 0, 4)}
    ids = {s: sorted(r.corpus_id for r in at.codes().filter(F.col("source") == s).collect()) for s in ("a b", "c", "d")}
    assert ids == {"a b": list(range(50)), "c": list(range(55)), "d": list(range(5))}
    at.clean()
    seen = tree(root)
    assert run_update(spark, root, files_of(spark, B), rows, 50) == dict.fromkeys(("a b", "c", "d"), "none") and tree(root) == seen
    assert at.codes().count() == 110


def test_modified_files_and_other_widths(spark, tmp_path):
    root = str(tmp_path / "index")
    rows, asked = rows_of(spark, B)
    run_update(spark, root, files_of(spark, B), rows, 50)
    newer = [(s, f, t + (9 if (s, f) == ("c", "f1") else 0), n) for s, f, t, n in B]
    assert run_update(spark, root, files_of(spark, newer), rows, 50) == {"a b": "none", "c": "full", "d": "none"}
    assert asked[-1] == [("c", "f0"), ("c", "f1"), ("c", "f2")] and Index(spark, root).codes().count() == 110
    assert set(run_update(spark, root, files_of(spark, newer), rows, 50, width=2).values()) == {"full"}
    codes = Index(spark, root).codes()
    assert codes.count() == 110 and "c1" in codes.columns
    assert Index(spark, str(tmp_path / "none")).codes() is None and Index(spark, str(tmp_path / "none")).chunks().collect() == []


def batches(seed, n=5):
    rng = random.Random(seed)
    return [[(f"k{rng.randrange(120)}" if rng.random() < 0.9 else None, rng.randrange(9)) for _ in range(80)] for _ in range(n)]


@pytest.mark.parametrize("bucket_keys", [5, 50_000])
def test_known_keys(spark, tmp_path, bucket_keys):
    schema = "key string, v int"
    known, want, nulls = KnownKeys(spark, str(tmp_path), "key", bucket_keys), set(), 0
    for number, rows in enumerate(batches(1)):
        df = spark.createDataFrame(rows, schema)
        fresh = {k for k, _ in rows if k is not None} - want
        none = sum(k is None for k, _ in rows)
        assert known.ingest(df, number) == len(fresh) + none
        # A batch that comes again after its commit adds nothing.
        assert known.ingest(df, number) == 0
        want |= fresh
        nulls += none
        got = [r.key for r in known.rows(schema).collect()]
        assert sorted(k for k in got if k) == sorted(want) and got.count(None) == nulls
    content = known.versions.latest()[1]
    assert sum(k["n"] for k in content["keys"]) == len(want)
    assert len(content["keys"]) <= 5 and (content["buckets"] > 1) == (bucket_keys == 5)


def test_a_batch_that_crashed_is_written_once(spark, tmp_path, monkeypatch):
    known = KnownKeys(spark, str(tmp_path), "key")
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 2)], "key string, v int")
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            known.ingest(df, 0)
    assert known.rows(df.schema).count() == 0
    assert known.ingest(df, 0) == 3 and known.rows(df.schema).count() == 3


def test_a_batch_reads_few_buckets(spark, tmp_path):
    known = KnownKeys(spark, str(tmp_path), "key", 20)
    known.ingest(spark.range(3000).selectExpr("concat('k', id) as key", "id as v"), 0)
    _, content = known.versions.latest()
    assert content["buckets"] > 60
    few = spark.createDataFrame([("k5", 1), ("k17", 1), ("new", 1)], "key string, v long")
    plan = known.new(few, content)
    # The scans of keys and of filters take the folders of the batch's buckets only.
    scans = re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+L? (?:IN \(([^)]*)\)|= (\d+))", plan._jdf.queryExecution().executedPlan().toString())
    assert scans and all(len((many or one).split(",")) <= 3 for many, one in scans)
    assert [r.key for r in plan.select("key").collect()] == ["new"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 7}" if i % 5 else None) for i in range(60)], "id long, text string")
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    known = ingest_known(spark, f"{tmp_path}/in", rows.schema, "text", f"{tmp_path}/out", f"{tmp_path}/check", files_per_batch=2)
    got = [r.text for r in known.rows(rows.schema).collect()]
    assert sorted(t for t in got if t) == [f"t{i}" for i in range(7)] and got.count(None) == 12
    rows.limit(3).selectExpr("id", "'late' as text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    known = ingest_known(spark, f"{tmp_path}/in", rows.schema, "text", f"{tmp_path}/out", f"{tmp_path}/check")
    assert known.rows(rows.schema).filter("text = 'late'").count() == 1


def test_long_keys_are_stored_as_digests(spark, tmp_path):
    """Keys of any length are told apart, and what is stored of one is no longer than its digest."""
    texts = ["a" * 5000, "a" * 5001, "x" * 64, "x" * 65, "é" * 40, "", None, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "id long, text string")
    known = KnownKeys(spark, str(tmp_path), "text")
    assert known.ingest(rows.filter("id < 3"), 0) == 3
    assert known.ingest(rows, 1) == 7
    assert sorted(r.text or "" for r in known.rows(rows.schema).collect()) == sorted([*(t or "" for t in texts), "", ""])
    keys = known._read("keys", [k["name"] for k in known.versions.latest()[1]["keys"]], "key string, hash long, bucket long")
    assert sorted(len(r.key) for r in keys.collect()) == [1, 64, 64, 64, 64, 65]
