import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup as module
from lodestar.llm.exact_dedup import FuseFilter, exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches,bucket", [(1, 50_000), (2, 3), (3, 5)])
def test_against_brute_force(spark, batches, bucket):
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", "a\x0cb ", "A b", "x" * 100_000, "a b", "é", "é"]
    rows = [(i * 7 % 60, texts[i % len(texts)] if i % 3 else f"text {i}") for i in range(60)] + [(3, "a b"), (3, "a b"), (None, "lonely"), (None, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    got = [tuple(r) for r in exact_dedup(df, batches, bucket_keys=bucket).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("most_bits", [module.MOST_BITS, 1])
def test_texts_of_one_digest_are_compared(spark, monkeypatch, most_bits):
    monkeypatch.setattr(module, "_digest", lambda plain: F.unhex(F.sha2(F.substring(plain, 1, 2), 256)))
    same = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "ef"), (None, "cd")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.keep_id) for r in exact_dedup(same, most_bits=most_bits).collect()) == [("1", 1), ("2", 2), ("3", 1), ("4", 4), ("None", 2)]
    other = spark.createDataFrame([(1, "abx"), (2, "cd"), (3, "aby"), (4, "ef")], "doc_id long, text string")
    with pytest.raises(Exception, match="different texts have one digest"):
        exact_dedup(other, most_bits=most_bits).collect()


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 5000, 60_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    f = FuseFilter.from_bytes(FuseFilter.build(keys).to_bytes())
    assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.01
