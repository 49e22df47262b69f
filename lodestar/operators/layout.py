"""A map's layout from its graph: epochs of attraction along edges and repulsion from hashed samples, as joins.

Positions are a table ``id, x, y``, written anew each epoch. An edge takes part in an epoch with a chance of its weight over the largest, by a hash of its ends and the epoch. An edge that takes part pulls its ends together, and its head is pushed from
``negatives`` samples: points are dealt to as many slots as there are points by a hash of id and epoch, and a sample is what lies in the slot that a hash of edge and epoch names, one point on average, so no table of numbers is needed and no rows are paired.
Moves of a point are summed by partial aggregates, so a point with many edges is no single task's work. The sum counts by the edges that take part at the point: all ends move at once, so the whole sum would carry a point past its neighbours, the further the more edges it has. Everything depends on ids, weights and the seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch
from .semmap import map_loss, nearness

#: The curve of closeness for a least distance of 0.1, and the bound of a single move.
A, B, CLIP = 1.576943460405378, 0.8950608781227859, 4.0
#: What keeps points at one place apart.
NEAR = 0.001


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))


def _at(positions: DataFrame, end: str) -> DataFrame:
    return positions.select(F.col("id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))


def sampled_points(edges: DataFrame, positions: DataFrame, n: int, negatives: int, seed: int, turn: int) -> DataFrame:
    """``head, other_x, other_y`` with the head's columns: ``negatives`` samples of all points for each edge, on average; a point is no sample of its own."""
    slots = positions.select(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "id"), F.lit(n)).alias("slot"), F.col("id").alias("other"), F.col("x").alias("other_x"), F.col("y").alias("other_y"))
    asked = edges.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(negatives))))
    asked = asked.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(turn), "draw", "head", "tail"), F.lit(n))).drop("draw")
    return asked.join(slots, "slot").filter(F.col("other") != F.col("head"))


def epoch_moved(edges: DataFrame, positions: DataFrame, n: int, most: float, rate: float, negatives: int, seed: int, turn: int) -> DataFrame:
    """``id, x, y`` after one epoch."""
    active = edges.filter(_chance(F.lit(seed), F.lit(turn), F.col("head"), F.col("tail")) < F.col("weight") / F.lit(most))
    placed = active.join(_at(positions, "head"), "head").join(_at(positions, "tail"), "tail")
    dx, dy = F.col("head_x") - F.col("tail_x"), F.col("head_y") - F.col("tail_y")
    square = dx * dx + dy * dy
    pull = F.when(square > 0, -2.0 * A * B * F.pow(square, F.lit(B - 1)) / (1.0 + A * F.pow(square, F.lit(B)))).otherwise(0.0)
    pulled = placed.select("head", "tail", _clipped(pull * dx).alias("px"), _clipped(pull * dy).alias("py"))
    drawn = sampled_points(active.join(_at(positions, "head"), "head"), positions, n, negatives, seed, turn)
    ex, ey = F.col("head_x") - F.col("other_x"), F.col("head_y") - F.col("other_y")
    away = ex * ex + ey * ey
    push = 2.0 * B / ((NEAR + away) * (1.0 + A * F.pow(away, F.lit(B))))
    pushed = drawn.select(F.col("head").alias("id"), _clipped(push * ex).alias("mx"), _clipped(push * ey).alias("my"), F.lit(0).alias("ends"))
    one = F.lit(1).alias("ends")
    moves = pulled.select(F.col("head").alias("id"), F.col("px").alias("mx"), F.col("py").alias("my"), one).unionByName(pulled.select(F.col("tail").alias("id"), (-F.col("px")).alias("mx"), (-F.col("py")).alias("my"), one)).unionByName(pushed)
    # Sums of whole millionths don't depend on their order.
    whole = lambda c: F.sum(F.round(F.col(c) * 1e6).cast("long")) / 1e6
    # An edge stands in the graph once for each direction, so a point has two ends of it.
    edges_of = F.greatest(F.sum("ends") / 2, F.lit(1.0))
    summed = moves.groupBy("id").agg((whole("mx") / edges_of).alias("mx"), (whole("my") / edges_of).alias("my"))
    return positions.join(summed, "id", "left").select("id", (F.col("x") + rate * F.coalesce("mx", F.lit(0.0))).alias("x"), (F.col("y") + rate * F.coalesce("my", F.lit(0.0))).alias("y"))


def layout(edges: DataFrame, start: DataFrame, epochs: int = 30, negatives: int = 5, rate: float = 1.0, seed: int = 42, every: int = 0) -> DataFrame | list[DataFrame]:
    """``id, x, y`` after ``epochs``. ``edges``: ``head, tail, weight``, each direction a row; ``start``: ``id, x, y`` of all points, which are brought to a width of ten. With ``every``, a list: the start and each so many epochs.

    Edges of points that aren't in ``start`` and null weights count as none; a point without edges stays where it is. The rate falls to nothing in a straight line.
    """
    spark = start.sparkSession
    scratch, kept = Scratch(spark, "layout"), Scratch(spark, "layouts")
    edges = scratch.write(edges.select("head", "tail", F.col("weight").cast("double").alias("weight")).filter("weight > 0 and head <> tail"), "edges")
    wide = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    most = edges.agg(F.max("weight")).first()[0]
    by = 10.0 / wide.m if wide.m else 1.0
    positions = scratch.write(start.select(F.col("id").cast("long").alias("id"), (F.col("x") * by).alias("x"), (F.col("y") * by).alias("y")), "positions")
    seen = [kept.write(positions, "epoch-0")] if every else []
    for turn in range(epochs if most else 0):
        positions = scratch.write(epoch_moved(edges, positions, wide.n, most, rate * (1 - turn / epochs), negatives, seed, turn), "positions")
        if every and (turn + 1) % every == 0:
            seen.append(kept.write(positions, f"epoch-{turn + 1}"))
    if every:
        scratch.clear()
        return seen
    scratch.keep("positions")
    return positions


def layout_loss(edges: DataFrame, positions: DataFrame, negatives: int = 5, seed: int = 7) -> float:
    """The mean cross entropy of edges, which count by their weight, and of ``negatives`` samples for each, which should be apart."""
    n = positions.count()
    ends = edges.join(_at(positions, "head"), "head")
    near = lambda a, b: nearness(F.hypot(F.col("head_x") - F.col(f"{a}_x"), F.col("head_y") - F.col(f"{b}_y")), A, B)
    own = ends.join(_at(positions, "tail"), "tail").select(map_loss(F.lit(1.0), near("tail", "tail")).alias("loss"), "weight")
    others = sampled_points(ends, positions, n, negatives, seed, -1).select(map_loss(F.lit(0.0), near("other", "other")).alias("loss"), "weight")
    sums = own.unionByName(others).agg((F.sum(F.col("loss") * F.col("weight")) / F.sum("weight")).alias("loss")).first()
    return sums.loss
