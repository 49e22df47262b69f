"""Next fit by pointer doubling, against going through the files one by one."""

import random

import pytest

from lodestar.operators.index import packed


def brute(files, capacity):
    out, state = {}, {}
    for source, stem, n in sorted(files, key=lambda f: (str(f[0]), f[1])):
        chunk, used = state.get(source, (-1, capacity + 1))
        if chunk < 0 or used + n > capacity:
            chunk, used = chunk + 1, 0
        state[source] = chunk, used + n
        out[source, stem] = chunk
    return out


@pytest.mark.parametrize("seed,capacity", [(2, 1), (3, 1000), (4, 7)])
def test_next_fit(spark, seed, capacity):
    rng = random.Random(seed)
    files = [(s, f"f{i:03d}", rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 35])) for s in ("a", "b", "c d", None) for i in range(rng.choice([1, 3, 60, 90]))]
    rng.shuffle(files)
    df = spark.createDataFrame(files, "source string, stem string, rows long")
    assert {(r.source, r.stem): r.chunk_id for r in packed(df, capacity).collect()} == brute(files, capacity)


def test_odd_files(spark):
    df = spark.createDataFrame([("a", "1", 0), ("a", "2", 0), ("b", "1", 99)], "source string, stem string, rows long")
    assert sorted((r.source, r.stem, r.chunk_id) for r in packed(df, 10).collect()) == [("a", "1", 0), ("a", "2", 0), ("b", "1", 0)]
    assert packed(df.limit(0), 10).collect() == []
