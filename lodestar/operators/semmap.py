"""The semantic map: samples, projections, grids, and one paper for each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import groups


def bounds(points: DataFrame, pad: float = 0.05, pad_y_by_x: bool = False) -> DataFrame:
    """One row ``x_lo, x_hi, y_lo, y_hi``: the range, widened on each side by a share of it (of x for both on request)."""
    ranges = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    dx, dy = pad * (F.col("b") - F.col("a")), pad * (F.col("d") - F.col("c"))
    dy = dx if pad_y_by_x else dy
    return ranges.select((F.col("a") - dx).alias("x_lo"), (F.col("b") + dx).alias("x_hi"), (F.col("c") - dy).alias("y_lo"), (F.col("d") + dy).alias("y_hi"))


def cell(v: Column, low: Column, high: Column, n: int, closed: bool = False) -> Column:
    """The half-open cell of a value; outside it is below 0 or ``n`` and more. ``closed`` puts the upper end into the last cell."""
    at = F.floor((v - low) / (high - low) * n).cast("int")
    return F.when(v == high, n - 1).otherwise(at) if closed else at


def gridded(points: DataFrame, edges: DataFrame, n: int, closed: bool = False) -> DataFrame:
    """Points with ``xi, yi``; those outside go. ``edges`` is the one row of ``bounds``."""
    at = points.crossJoin(F.broadcast(edges)).withColumn("xi", cell(F.col("x"), F.col("x_lo"), F.col("x_hi"), n, closed)).withColumn("yi", cell(F.col("y"), F.col("y_lo"), F.col("y_hi"), n, closed))
    return at.filter(F.col("xi").between(0, n - 1) & F.col("yi").between(0, n - 1))


def histogram(cells: DataFrame, source: str = "source") -> DataFrame:
    """``source, xi, yi, n, log_n`` by source and for ``all``; empty cells have no row."""
    each = cells.groupBy(source, "xi", "yi").agg(F.count(F.lit(1)).alias("n"))
    every = each.groupBy("xi", "yi").agg(F.sum("n").alias("n")).select(F.lit("all").alias(source), "xi", "yi", "n")
    return each.unionByName(every).withColumn("log_n", F.log1p("n"))


def centers(cells: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    step = lambda a, b: (F.col(b) - F.col(a)) / n
    at = cells.crossJoin(F.broadcast(edges))
    return at.withColumn("cx", F.col("x_lo") + (F.col("xi") + 0.5) * step("x_lo", "x_hi")).withColumn("cy", F.col("y_lo") + (F.col("yi") + 0.5) * step("y_lo", "y_hi")).drop("x_lo", "x_hi", "y_lo", "y_hi")


def representatives(cells: DataFrame, order: list[str], last: bool = False) -> DataFrame:
    """One point for each cell, the first in order or the last; partial aggregates go over the shuffle."""
    pick = F.max_by if last else F.min_by
    kept = [c for c in cells.columns if c not in ("xi", "yi")]
    return cells.groupBy("xi", "yi").agg(pick(F.struct(*kept), F.struct(*order)).alias("p")).select("xi", "yi", "p.*")


def cell_label(title: Column, date: Column, source: Column, cut: int = 100, undated: str = "n.d.") -> Column:
    short = F.when(F.length(title) > cut, F.concat(F.substring(title, 1, cut), F.lit("..."))).otherwise(title)
    year = F.when(F.length(date) > 0, F.substring(date, 1, 4)).otherwise(undated)
    return F.concat(F.lit("<b>"), short, F.lit("</b><br>("), year, F.lit(") "), source)


def _shuffled(key: Column, seed: int) -> Column:
    """An order that depends on key and seed only."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, n: int, stratum: str = "chunk_id", seed: int = 42, key: str = "id") -> DataFrame:
    """About ``n`` rows, from each stratum by its share and one at least; all rows if there are no more. Order is by a hash of key and seed, so reruns agree."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if total <= n:
        return rows
    share = counts.withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(n) / F.lit(total))))
    dealt = rows.withColumn("_h", _shuffled(F.col(key), seed))
    ranked = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    kept = ranked.join(share.select(stratum, "_take"), stratum).filter(F.col("_n") <= F.col("_take"))
    return kept.orderBy("_h", key).limit(n).select(*rows.columns)


def bernoulli(rows: DataFrame, n: int, total: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Each row with chance ``n / total`` by a hash of its key; of more than ``n`` the first by that hash, wherever they are stored."""
    chance = F.conv(F.substring(_shuffled(F.col(key), seed), 1, 13), 16, 10).cast("long") / F.lit(16**13)
    kept = rows.filter(chance < n / max(1, total)).withColumn("_h", _shuffled(F.col(key), seed))
    return kept.orderBy("_h", key).limit(n).select(*rows.columns)


def nearness(distance: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """The logarithm of a map distance's odds: ``-ln(1 + a d^(2b))``."""
    return -F.log1p(F.lit(a) * F.pow(distance, F.lit(2 * b)))


def log_sigmoid(x: Column) -> Column:
    """``ln(1 / (1 + e^-x))``, without overflow at either end."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def map_loss(weight: Column, odds: Column, repulsion: float = 1.0) -> Column:
    """Cross entropy of a graph weight and a map's log odds: attraction and repulsion."""
    attraction = -weight * log_sigmoid(odds)
    return attraction - (1.0 - weight) * (log_sigmoid(odds) - odds) * repulsion


class Projection:
    """Layers of a map: vectors are multiplied through them in batches, with a ramp between layers. Fitted, applied, saved and loaded like any model."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    @classmethod
    def fit(cls, rows: DataFrame, embedding: str = "embedding") -> Projection | None:
        """The two main components, as one layer; None without rows."""
        axes, mean = _main_axes(rows, embedding)
        return None if axes is None else cls([(axes, -mean @ axes)])

    def transform(self, rows: DataFrame, embedding: str = "embedding", id_: str = "id") -> DataFrame:
        """``id, x, y``; rows without a vector go."""
        at = self.outputs(rows, embedding, id_)
        return at.select("id", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))

    def outputs(self, rows: DataFrame, embedding: str = "embedding", id_: str = "id") -> DataFrame:
        """``id, at``: the last layer's values, as many as it has; rows without a vector go. Weights go to the tasks once: their size is the map's, not the table's."""
        sent = rows.sparkSession.sparkContext.broadcast(self.layers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layers = sent.value
            for batch in batches:
                real = batch.filter(batch.column(1).is_valid())
                if real.num_rows:
                    at = real.column(1).flatten().to_numpy(zero_copy_only=False).reshape(real.num_rows, -1)
                    for k, (w, b) in enumerate(layers):
                        at = at @ w + b if k == len(layers) - 1 else np.maximum(at @ w + b, 0)
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1])
                    yield pa.RecordBatch.from_arrays([real.column(0), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(at).ravel()))], names=["id", "at"])

        return rows.select(F.col(id_).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, "id long, at array<double>")

    def save(self, spark, path: str) -> None:
        rows = [(k, w.shape[0], w.shape[1], w.ravel().tolist(), np.asarray(b).tolist()) for k, (w, b) in enumerate(self.layers)]
        spark.createDataFrame(rows, "layer int, n int, m int, weights array<double>, bias array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Projection:
        return cls([(np.array(r.weights).reshape(r.n, r.m), np.array(r.bias)) for r in spark.read.parquet(path).orderBy("layer").collect()])


def _main_axes(rows: DataFrame, embedding: str) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The two main components and the mean. Tasks sum products into one matrix of the vector's width; signs are fixed so that the largest loading is positive."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = [x for x in batch.column(0).to_pylist() if x is not None]
            if v:
                a = np.concatenate([np.ones((len(v), 1)), np.array(v, float)], axis=1)
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "v": total.ravel()})

    cells = rows.select(embedding).mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not cells:
        return None, None
    m = np.zeros((1 + max(c.i for c in cells),) * 2)
    for c in cells:
        m[c.i, c.j] = c.v
    mean = m[0, 1:] / m[0, 0]
    _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    axes = vectors[:, [-1, -2]]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]]), mean


def pca_projection(rows: DataFrame, embedding: str = "embedding", id_: str = "id") -> DataFrame:
    """``id, x, y``: the two main components, applied by expressions."""
    axes, mean = _main_axes(rows, embedding)
    if axes is None:
        return rows.sparkSession.createDataFrame([], "id long, x double, y double")

    def along(k: int) -> Column:
        weights = F.array(*(F.lit(float(w)) for w in axes[:, k]))
        return F.aggregate(F.zip_with(F.col(embedding), weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - F.lit(float(mean @ axes[:, k]))

    return rows.filter(F.col(embedding).isNotNull()).select(F.col(id_).alias("id"), along(0).alias("x"), along(1).alias("y"))


def edge_weights(edges: DataFrame, epochs: int) -> DataFrame:
    """``head, tail, weight, repeats`` of a graph: repeated edges are summed, those below the largest over ``epochs`` go; an edge is repeated ``epochs`` times its weight, rounded down."""
    summed = edges.groupBy("head", "tail").agg(F.sum("weight").alias("weight"))
    most = summed.agg(F.max("weight").alias("_most"))
    kept = summed.crossJoin(F.broadcast(most)).filter(F.col("weight") >= F.col("_most") / epochs).drop("_most")
    return kept.withColumn("repeats", F.floor(F.col("weight") * epochs).cast("int"))


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """Symmetric membership ``a + b - ab`` of directed weights."""
    back = edges.select(F.col("tail").alias("head"), F.col("head").alias("tail"), F.col("weight").alias("_w"))
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("_w", F.lit(0.0))
    return edges.join(back, ["head", "tail"], "full").select("head", "tail", (a + b - a * b).alias("weight"))


def smooth_knn(neighbours: DataFrame, iterations: int = 64) -> DataFrame:
    """``head, tail, weight`` of ``head, tail, dist`` with ``k`` neighbours each: distances beyond the nearest decay so that a head's weights sum to log2 k. Thousands of heads are solved at once, as rows of one matrix."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            head, dist = table.column("head").to_numpy(), table.column("dist").to_numpy().astype(float)
            start = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
            size = np.diff(np.append(start, len(head)))
            row = np.repeat(np.arange(len(start)), size)
            at = np.full((len(start), size.max()), np.inf)
            at[row, np.arange(len(head)) - start[row]] = dist
            positive = np.where(at > 0, at, np.inf).min(axis=1)
            near = np.where(np.isinf(positive), 0.0, positive)
            beyond, goal = np.maximum(at - near[:, None], 0), np.log2(np.maximum(2, size))
            low, high, sigma = np.zeros(len(start)), np.full(len(start), np.inf), np.ones(len(start))
            for _ in range(iterations):
                over = np.exp(-beyond / sigma[:, None]).sum(axis=1) > goal
                low, high = np.where(over, low, sigma), np.where(over, sigma, high)
                sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
            mean = np.add.reduceat(dist, start) / size
            sigma = np.maximum(sigma, np.maximum(1e-3 * mean, 1e-12))
            weight = np.exp(-np.maximum(dist - near[row], 0) / sigma[row])
            yield pa.RecordBatch.from_arrays([table.column("head").combine_chunks(), table.column("tail").combine_chunks(), pa.array(weight)], names=["head", "tail", "weight"])

    rows = neighbours.select(F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"), F.col("dist").cast("double").alias("dist"))
    return rows.repartition("head").sortWithinPartitions("head", "dist", "tail").mapInArrow(solve, "head long, tail long, weight double")


def scatter(results: DataFrame) -> DataFrame:
    """Plot columns: dates as days, unread ones at the earliest, and marker sizes by citations."""
    earliest = results.agg(F.min("day").alias("_first"))
    size = F.log1p(F.coalesce("citations", F.lit(0))) * 5 + 5
    return results.crossJoin(F.broadcast(earliest)).withColumn("day", F.coalesce("day", "_first", F.current_date())).withColumn("marker_size", size).drop("_first")
