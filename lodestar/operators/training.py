"""Training of map projections: mini-batch gradients summed by tasks, Adam on the driver over a fixed number of weights.

Pairs of vectors are written once as blocks of a fixed number of rows, dealt to mini-batches by a hash of the id. A step reads one batch; each block gives the sum of its gradients, and the driver adds the sums of a batch in block order, so reruns give the same weights bit by bit.
A step is a job, so an epoch has ``MOST_BATCHES`` steps at most, and larger tables have larger batches; all rows are in one of them. The driver holds the weights and the gradients of the blocks of one batch: blocks grow too, and are ``MOST_BLOCKS`` at most.

Between layers stand a batch norm (over a block while training, over running means when exported: it is folded into weights and biases) and a ramp. Inputs and targets are scaled to unit spread, which is folded into the first and last layer.
Rows where either vector is null or holds one, or has another length than the first row's, aren't trained on. Without rows there is no projection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, groups
from .semmap import Projection

BLOCK_ROWS = 512
#: Batches of an epoch, and blocks of a batch, at most.
MOST_BATCHES = MOST_BLOCKS = 64
#: Of Adam, and of a batch norm.
RATES, TINY, MOMENTUM = (0.9, 0.999), 1e-8, 0.9

Layer = dict[str, np.ndarray]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its vectors and targets as bytes."""
    for table in groups(batches, 2):
        key = np.column_stack([table.column(i).to_numpy() for i in range(2)])
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            vectors, targets = (table.column(i).slice(a, b - a).combine_chunks().flatten().to_numpy() for i in (3, 4))
            yield pa.RecordBatch.from_pydict({"batch": [int(key[a, 0])], "block": [int(key[a, 1])], "n": [int(b - a)], "vectors": [vectors.tobytes()], "targets": [targets.tobytes()]})


def _forward(layers: Sequence[Layer], at: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The output, and of each layer what its gradient needs."""
    kept = []
    for k, p in enumerate(layers):
        z = at @ p["w"] + p["b"]
        if k == len(layers) - 1:
            kept.append((at,))
            return z, kept
        mean, spread = z.mean(axis=0), np.sqrt(z.var(axis=0) + 1e-5)
        unit = (z - mean) / spread
        out = unit * p["scale"] + p["shift"]
        kept.append((at, unit, spread, out > 0, mean))
        at = np.maximum(out, 0)
    raise AssertionError


def _gradient(layers: Sequence[Layer], vectors: np.ndarray, targets: np.ndarray) -> tuple[list[Layer], float, list[tuple]]:
    """Sums over the rows of the gradient of half the squared error, the squared error, and means and spreads of the hidden layers."""
    got, kept = _forward(layers, vectors)
    back = got - targets
    error = float((back**2).sum())
    grads: list[Layer] = [{} for _ in layers]
    for k in range(len(layers) - 1, -1, -1):
        if k < len(layers) - 1:
            _, unit, spread, up, _ = kept[k]
            back = back * up
            grads[k]["scale"], grads[k]["shift"] = (back * unit).sum(axis=0), back.sum(axis=0)
            back = back * layers[k]["scale"]
            back = (back - back.mean(axis=0) - unit * (back * unit).mean(axis=0)) / spread
        grads[k]["w"], grads[k]["b"] = kept[k][0].T @ back, back.sum(axis=0)
        back = back @ layers[k]["w"].T
    return grads, error, [(x[4], x[2] ** 2) for x in kept[:-1]]


def _flat(layers: Sequence[Layer]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for p in layers for name in sorted(p)])


def _shaped(flat: np.ndarray, like: Sequence[Layer]) -> list[Layer]:
    out, at = [], 0
    for p in like:
        own = {}
        for name in sorted(p):
            own[name] = flat[at : at + p[name].size].reshape(p[name].shape)
            at += p[name].size
        out.append(own)
    return out


def dealing(n: int, batch_rows: int) -> tuple[int, int]:
    """Batches of an epoch and blocks of a batch for ``n`` rows."""
    batches = min(MOST_BATCHES, max(1, round(n / batch_rows)))
    return batches, min(MOST_BLOCKS, max(1, round(n / batches / BLOCK_ROWS)))


def train_projection(rows: DataFrame, vector: str = "embedding", target: str = "target", id_: str = "id", hidden: Sequence[int] = (64,), epochs: int = 30, batch_rows: int = 4096, rate: float = 0.01, seed: int = 42) -> Projection | None:
    """A projection from ``vector`` to ``target`` (arrays of numbers), trained on all ``rows``. Batches have ``batch_rows`` rows, or more if there would be over ``MOST_BATCHES``. The rate falls to a tenth over the epochs."""
    spark = rows.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    pairs = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("array<double>").alias("t")).filter(whole("v") & whole("t"))
    first = pairs.orderBy("id").select(F.size("v"), F.size("t")).first()
    if first is None:
        return None
    wide, out = first
    pairs = pairs.filter((F.size("v") == wide) & (F.size("t") == out))
    scratch = Scratch(spark, "training")
    pairs = scratch.write(pairs, "pairs")
    n = pairs.count()

    def spread(column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = [F.get(column, F.lit(i)) for i in range(size)]
        r = pairs.agg(*(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
        return np.array(r[:size]), np.maximum(np.array(r[size:]), 1e-9)

    (v_mean, v_spread), (t_mean, t_spread) = (tuple(np.round(x, 9) for x in spread(c, s)) for c, s in (("v", wide), ("t", out)))
    v_spread, t_spread = np.maximum(v_spread, 1e-9), np.maximum(t_spread, 1e-9)
    batches, blocks = dealing(n, batch_rows)
    dealt = pairs.select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(batches)).cast("long").alias("batch"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(blocks)).cast("long").alias("block"), "id", "v", "t")
    packed = dealt.repartition("batch", "block").sortWithinPartitions("batch", "block", "id").mapInArrow(_packed, "batch long, block long, n long, vectors binary, targets binary")
    path = f"{scratch.root}/blocks"
    packed.write.partitionBy("batch").parquet(path)
    table = spark.read.schema("block long, n long, vectors binary, targets binary, batch long").parquet(path)

    rng, sizes = np.random.default_rng(seed), (wide, *hidden, out)
    layers: list[Layer] = []
    for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        layers.append({"w": rng.normal(0, np.sqrt(2 / a), (a, b)), "b": np.zeros(b)})
        if k < len(hidden):
            layers[-1] |= {"scale": np.ones(b), "shift": np.zeros(b)}
    running = [(np.zeros(m), np.ones(m)) for m in hidden]
    first_moment = second_moment = np.zeros(len(_flat(layers)))

    def step(batch: int, layers: list[Layer]) -> tuple[np.ndarray, int, list]:
        sent = spark.sparkContext.broadcast(layers)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            for part in parts:
                for block, n_, v, t in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    v = (np.frombuffer(v).reshape(n_, wide) - v_mean) / v_spread
                    t = (np.frombuffer(t).reshape(n_, out) - t_mean) / t_spread
                    grads, _, stats = _gradient(now, v, t)
                    told = np.concatenate([_flat(grads), *(x for s in stats for x in s)])
                    yield pa.RecordBatch.from_pydict({"block": [block], "n": [n_], "told": [told.tobytes()]})

        got = sorted(table.filter(F.col("batch") == batch).drop("batch").mapInArrow(run, "block long, n long, told binary").collect())
        sent.unpersist()
        told = [np.frombuffer(r.told) for r in got]
        total = sum(r.n for r in got)
        if not total:
            return np.zeros(len(first_moment)), 0, []
        size, stats, at = len(first_moment), [], 0
        for m in hidden:
            mean, var = (sum(r.n * x[size + at + i * m : size + at + (i + 1) * m] for r, x in zip(got, told, strict=True)) / total for i in (0, 1))
            stats.append((mean, var))
            at += 2 * m
        return sum(x[:size] for x in told) / total, total, stats

    done = 0
    for epoch in range(epochs):
        for batch in rng.permutation(batches):
            grad, total, stats = step(int(batch), layers)
            if not total:
                continue
            done += 1
            first_moment = RATES[0] * first_moment + (1 - RATES[0]) * grad
            second_moment = RATES[1] * second_moment + (1 - RATES[1]) * grad**2
            move = first_moment / (1 - RATES[0] ** done) / (np.sqrt(second_moment / (1 - RATES[1] ** done)) + TINY)
            layers = _shaped(_flat(layers) - rate * 0.1 ** (epoch / max(1, epochs - 1)) * move, layers)
            # The first means stand for themselves, later ones are taken in slowly.
            keep = min(MOMENTUM, 1 - 1 / done)
            running = [tuple(keep * old + (1 - keep) * new for old, new in zip(r, s, strict=True)) for r, s in zip(running, stats, strict=True)]
    scratch.clear()
    return Projection(_folded(layers, running, (v_mean, v_spread), (t_mean, t_spread)))


def _folded(layers: Sequence[Layer], running: Sequence[tuple], given: tuple, wanted: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases alone: batch norms and the scaling of inputs and targets go into them."""
    out = []
    for k, p in enumerate(layers):
        w, b = p["w"].copy(), p["b"].copy()
        if k == 0:
            w = w / given[1][:, None]
            b = b - given[0] @ w
        if k < len(running):
            by = p["scale"] / np.sqrt(running[k][1])
            w, b = w * by, (b - running[k][0]) * by + p["shift"]
        if k == len(layers) - 1:
            w, b = w * wanted[1], b * wanted[1] + wanted[0]
        out.append((w, b))
    return out


def squared_error(found: DataFrame, rows: DataFrame, target: str = "target", id_: str = "id") -> float:
    """The mean over rows of the squared distance of ``found`` (``id, at``) to the target."""
    both = found.join(rows.select(F.col(id_).cast("long").alias("id"), F.col(target).cast("array<double>").alias("t")), "id")
    apart = F.aggregate(F.zip_with("at", "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.avg(apart)).first()[0]
