"""Queries on neighbour graphs, stored indexes, trained projections and map layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import semmap
from ..operators.layout import layout, layout_loss
from ..operators.multi_index import MultiIndex
from ..operators.neighbours import approximate_knn, recall
from ..operators.search import knn
from ..operators.training import squared_error, train_projection
from ..session import shared_dir
from .queries import ORACLE, query, stored, table


@query("select cast(count(*) as bigint) as queries, true as reached from embeddings where vec_id % 100 = 0")
def knn_graph_recall(spark, sf_dir):
    """Whether the approximate graph of all codes has nine of ten of the true neighbours of the stated queries."""
    c = stored(spark, sf_dir)
    near = knn(c, c.filter("id % 100 = 0"), 11).filter("query_id <> id").withColumn("n", F.expr("row_number() over (partition by query_id order by dist, id)")).filter("n <= 10")
    return recall(approximate_knn(c, 10), near).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query(ORACLE["multi_query_topk"])
def multi_index_topk(spark, sf_dir):
    """The rows of ``multi_query_topk`` from a stored multi-index."""
    c = stored(spark, sf_dir)
    index = MultiIndex.build(c.select("id", "c0"), f"{shared_dir(spark)}/lodestar/multi-index-{uuid.uuid4().hex}")
    return index.topk(c.filter("id % 100 = 0"), 50).select("query_id", "id", "dist", F.col("rank").cast("long").alias("rank"))


def graph(spark, sf_dir):
    """Fuzzy graph of all points over ten neighbours each."""
    return semmap.fuzzy_union(semmap.smooth_knn(approximate_knn(stored(spark, sf_dir), 10)))


@query()
def fuzzy_graph(spark, sf_dir):
    """Ten neighbours of every point, by neighbour refinement; there is no sample."""
    return graph(spark, sf_dir)


@query("select cast(count(*) as bigint) as rows, true as below_linear from embeddings")
def projection_training(spark, sf_dir):
    """A projection trained on a bent surface over the embeddings; its error against that of the linear fit of the same pairs, which training without a hidden layer approaches from above."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    at = lambda i: F.get("embedding", F.lit(i))
    pairs = e.withColumn("target", F.array(F.abs(at(0)) * 4 + at(1), F.abs(at(2)) * 4 - at(3)))
    bent, flat = (train_projection(pairs, hidden=h, epochs=12, batch_rows=1024, rate=0.02) for h in ((32,), ()))
    error, linear = (squared_error(p.outputs(pairs), pairs) for p in (bent, flat))
    return pairs.agg(F.count(F.lit(1)).alias("rows")).withColumn("below_linear", F.lit(error < linear))


@query("select cast(count(*) as bigint) as points, true as falls from embeddings")
def map_layout(spark, sf_dir):
    """Twenty epochs of the layout of the embeddings' graph, from their main components: the loss falls each ten."""
    edges = graph(spark, sf_dir)
    seen = layout(edges, semmap.pca_projection(table(spark, sf_dir, "embeddings"), id_="vec_id"), epochs=20, every=10)
    losses = [layout_loss(edges, p) for p in seen]
    return seen[-1].agg(F.count(F.lit(1)).alias("points")).withColumn("falls", F.lit(losses[0] > losses[1] > losses[2]))
