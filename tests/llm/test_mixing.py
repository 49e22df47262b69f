import random
import re

import numpy as np
import pytest

from lodestar.llm.mixing import flight, landing, mixed, mixing


def goals(sizes):
    """Targets by the rule as stated: share, cut, share the excess again."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while rest > 1e-9 and free:
        unit, rest = rest / sum(w[x] for x in free), 0.0
        for x in list(free):
            target[x] += unit * w[x]
            if target[x] >= 2 * sizes[x]:
                rest += target[x] - 2 * sizes[x]
                target[x] = 2.0 * sizes[x]
                free.discard(x)
    return target


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("w" * (1 + k % 3) for k in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["a", "a", "a", "b", "é", "z", None, "tiny"] if i % 9 else ["a"])) for i in range(n)] + [(3, None, "a"), (3, "x\ty\x0bz", "b"), (None, "q", None)]


@pytest.mark.parametrize("cell,slack", [(40, 90), (20_000, 40)])
def test_totals(spark, cell, slack):
    data = rows(400)
    df = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, source string, target double")
    out = mixing(df, cell_rows=cell).collect()
    assert len(out) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = goals(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= slack, (s, n, want[s])
    assert sorted(map(str, out)) == sorted(map(str, mixing(df.repartition(3), cell_rows=cell).collect()))


def test_rows_are_repeated(spark):
    df = spark.createDataFrame(rows(60), "doc_id long, text string, source string")
    out = mixed(df)
    assert out.columns == df.columns
    want = sum(r.copies for r in mixing(df).collect())
    assert out.count() == want and out.exceptAll(df.unionAll(df)).count() == 0


def test_large_and_null_ids_stay_exact(spark):
    data = [(2**60 + i if i else None, "w " * (i % 7), "a") for i in range(70)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert sorted((str(r.doc_id) for r in mixing(df, cell_rows=30).collect())) == sorted(str(d[0]) for d in data)
    nulls = spark.createDataFrame([(None, f"{i} w" * (i % 5), "ab"[i % 2], i) for i in range(80)] * 2, "doc_id long, text string, source string, copies int")
    out = mixed(nulls, cell_rows=30)
    assert out.columns == nulls.columns and out.count() == sum(r.copies for r in mixing(nulls, cell_rows=30).collect())
    assert out.exceptAll(nulls.unionAll(nulls)).count() == 0


def test_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing(none).collect() == []
    assert [r.taken for r in mixing(spark.createDataFrame([(1, None, None)], none.schema)).collect()] == [0]


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, s = rng.random(500), rng.integers(0, 50, 500)
    q = flight(p, s, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs((q - p).sum()) < 1e-6 and abs(((q - p) * s).sum()) < 1e-5
    assert set(landing(q, s)) <= {0.0, 1.0}
    mean = np.mean([landing(flight(p[:20], s[:20], np.random.default_rng(k)), s[:20]) for k in range(3000)], axis=0)
    assert np.abs(mean - p[:20]).mean() < 0.08
