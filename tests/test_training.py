"""Trained projections and map layouts: better than the linear and unmoved ones, the same on reruns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import semmap
from lodestar.operators.layout import layout, layout_loss
from lodestar.operators.neighbours import approximate_knn
from lodestar.operators.semmap import Projection
from lodestar.operators.training import _flat, _gradient, _shaped, dealing, squared_error, train_projection


def pairs(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6)) * [1, 2, 1, 1, 5, 1] + [0, 3, 0, 0, 0, 0]
    t = np.stack([np.abs(v[:, 0]) * 3 + v[:, 2], v[:, 1] * np.maximum(v[:, 3], 0) + 50], axis=1)
    rows = [(i, v[i].tolist(), t[i].tolist(), "z") for i in range(n)]
    rows += [(n, None, [0.0, 0.0], "z"), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0], "z"), (n + 2, [1.0], [0.0, 0.0], "z")]
    linear = np.linalg.lstsq(np.c_[v, np.ones(n)], t, rcond=None)
    return spark.createDataFrame(rows, "id long, embedding array<double>, target array<double>, batch string"), float(((np.c_[v, np.ones(n)] @ linear[0] - t) ** 2).sum(axis=1).mean())


def test_gradients():
    rng = np.random.default_rng(1)
    layers = [{"w": rng.normal(size=(4, 5)), "b": rng.normal(size=5), "scale": rng.normal(size=5), "shift": rng.normal(size=5)}, {"w": rng.normal(size=(5, 2)), "b": rng.normal(size=2)}]
    v, t = rng.normal(size=(9, 4)), rng.normal(size=(9, 2))
    got = _flat(_gradient(layers, v, t)[0])
    flat = _flat(layers)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (_gradient(_shaped(flat + s, layers), v, t)[1] / 2 for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_below_a_linear_fit_and_the_same_each_time(spark, tmp_path):
    rows, linear = pairs(spark)
    real = rows.filter("id < 3000")
    model = train_projection(rows, hidden=(32,), epochs=15, batch_rows=600, rate=0.03)
    error = squared_error(model.outputs(real), real)
    assert error < 0.25 * linear
    again = train_projection(rows.repartition(5), hidden=(32,), epochs=15, batch_rows=600, rate=0.03)
    assert all((a == b).all() and (c == d).all() for (a, c), (b, d) in zip(model.layers, again.layers, strict=True))
    model.save(spark, f"{tmp_path}/model")
    loaded = Projection.load(spark, f"{tmp_path}/model")
    assert squared_error(loaded.outputs(real), real) == pytest.approx(error)
    x, y = (sorted((r.id, r[c]) for r in loaded.transform(real.limit(5)).collect()) for c in ("x", "y"))
    assert len(x) == len(y) == 5


def test_the_way_back(spark):
    """The inverse is trained like the projection, from points to vectors."""
    n = 1500
    rng = np.random.default_rng(2)
    p = rng.normal(size=(n, 2))
    v = np.stack([p[:, 0], p[:, 1], np.abs(p[:, 0]), p[:, 0] * p[:, 1]], axis=1)
    rows = spark.createDataFrame([(i, p[i].tolist(), v[i].tolist()) for i in range(n)], "id long, point array<double>, embedding array<double>")
    back = train_projection(rows, "point", "embedding", hidden=(32, 16), epochs=20, batch_rows=500, rate=0.03)
    assert squared_error(back.outputs(rows, "point"), rows, "embedding") < 0.3


def test_without_rows(spark):
    assert train_projection(spark.createDataFrame([], "id long, embedding array<double>, target array<double>")) is None


def clusters(spark, groups=6, size=25, seed=4):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        center = rng.getrandbits(64)
        for i in range(size):
            x = center
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            rows.append((g * size + i, x - 2**64 if x >> 63 else x, g))
    return spark.createDataFrame(rows, "id long, c0 long, cluster int")


def test_layout(spark):
    points = clusters(spark)
    edges = semmap.fuzzy_union(semmap.smooth_knn(approximate_knn(points, 8)))
    start = points.select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100 - 5).alias("x"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000)) / 100 - 5).alias("y"))
    seen = layout(edges, start, epochs=20, every=10)
    losses = [layout_loss(edges, p) for p in seen]
    assert len(seen) == 3 and losses[0] > losses[1] > losses[2]
    at = {r.id: (r.x, r.y) for r in seen[-1].collect()}
    assert len(at) == 150
    # The nearest point on the map is of the same cluster, far oftener than by chance.
    same = sum(min((j for j in at if j != i), key=lambda j: np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1])) // 25 == i // 25 for i in at)
    assert same > 120


def test_layout_odd_edges(spark):
    start = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 5.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 1, 9.0), (1, 9, 1.0), (2, 3, None)], "head long, tail long, weight double")
    a, b = (sorted(map(tuple, layout(edges, s, epochs=3).collect())) for s in (start, start.repartition(3)))
    assert a == b and [r[0] for r in a] == [1, 2, 3] and a[2] == (3, 10.0, 10.0)
    none = layout(edges.filter("weight > 5"), start, epochs=3).collect()
    assert sorted(map(tuple, none)) == [(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 10.0, 10.0)]


def test_weights_of_many_heads(spark):
    """Solved together as each would be alone."""
    rng = random.Random(6)
    rows = [(h, h * 100 + t, float(rng.randrange(4)) * (h % 7)) for h in range(300) for t in range(rng.randrange(1, 9))]
    got = {}
    for r in semmap.smooth_knn(spark.createDataFrame(rows, "head int, tail int, dist double")).collect():
        got.setdefault(r.head, {})[r.tail] = r.weight
    for h in range(300):
        d = np.array([x for a, _, x in rows if a == h])
        goal, near = np.log2(max(2, len(d))), d[d > 0].min() if (d > 0).any() else 0.0
        low, high, sigma = 0.0, np.inf, 1.0
        for _ in range(64):
            low, high = (low, sigma) if np.exp(-np.maximum(d - near, 0) / sigma).sum() > goal else (sigma, high)
            sigma = sigma * 2 if np.isinf(high) else (low + high) / 2
        want = np.exp(-np.maximum(d - near, 0) / max(sigma, 1e-3 * d.mean(), 1e-12))
        assert [got[h][t] for a, t, _ in rows if a == h] == pytest.approx(want.tolist())


def test_loss_falls_where_points_have_many_edges(spark):
    """All ends of a point's edges move at once: their whole sum would throw it past its neighbours."""
    rng = np.random.default_rng(5)
    at = rng.normal(size=(300, 2)) * 3
    near = np.argsort(((at[:, None] - at[None]) ** 2).sum(axis=2), axis=1)[:, 1:31]
    ends = {(i, int(j)) for i in range(300) for j in near[i]}
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in sorted(ends | {(j, i) for i, j in ends})], "head long, tail long, weight double")
    start = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    losses = [layout_loss(edges, p) for p in layout(edges, start, epochs=10, every=5)]
    assert losses[0] > losses[1] > losses[2]


def test_steps_of_an_epoch_do_not_grow_with_the_table():
    assert dealing(3000, 600) == (5, 1) and dealing(500, 1024) == (1, 1)
    assert dealing(60_000, 1024) == (59, 2)
    for n in (615_000, 10**9):
        batches, blocks = dealing(n, 1024)
        assert batches <= 64 and blocks <= 64
