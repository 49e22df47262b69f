"""Fetch by key: no exchange over the papers, abstracts read for the final rows only, row groups skipped."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search
from lodestar.sources import catalog


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    n = 40_000
    papers = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "PubMed").otherwise("arXiv").alias("source"), F.col("id").alias("corpus_id"), F.concat(F.lit("10.1/x"), "id").alias("doi"), F.concat(F.lit("t"), "id").alias("title"), F.lit("A B").alias("authors"),
        F.lit("2010-05-05").alias("date"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("b"), "id"), 512)).alias("abstract"), F.lit("J").alias("journal"),
    )
    codes = papers.select("source", "corpus_id", (F.col("corpus_id") % 4).alias("chunk_id"), F.xxhash64("corpus_id").alias("c0"))
    path = str(tmp_path_factory.mktemp("papers"))
    return papers, codes, catalog.write_papers_by_key(papers, f"{path}/p", 4, row_group_bytes=1 << 18)


def test_same_rows(made):
    papers, codes, table = made
    want, got = ([tuple(r) for r in search.search(codes, p, [12345], 10, "2001-01-01", "2020-01-01", True, by_key=k).collect()] for p, k in ((papers, False), (table, True)))
    assert got == want and len(got) == 10


def test_plan(spark, made):
    _, codes, table = made
    narrow = table.filter(F.col("abstract_length") > 75).select("source", "corpus_id", "doi", "title")
    hits = search.topk_per_chunk(codes, [12345], 5000, ("source", "chunk_id"), ("corpus_id",)).select("source", "corpus_id", "dist")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = narrow.join(hits, ["source", "corpus_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    papers_side = plan[plan.index("SortMergeJoin") :].split("FileScan parquet")[0]
    assert "SelectedBucketsCount: 4 out of 4" in plan and "Exchange" not in papers_side
    scan = re.search(r"FileScan parquet spark_catalog[^\n]*", plan)[0]
    assert "abstract_length" in scan and not re.search(r"abstract#", scan)


def test_few_row_groups_are_read(made):
    _, _, table = made
    some = catalog.by_ids(table, [("PubMed", 100), ("PubMed", 104), ("arXiv", 39_999)])
    assert sorted(r.corpus_id for r in some.collect()) == [100, 104, 39_999]
    assert "In(corpus_id, [100,104,39999])" in some._jdf.queryExecution().executedPlan().toString()
    metrics = {}
    node = some._jdf.queryExecution().executedPlan()
    stack = [node]
    while stack:
        x = stack.pop()
        if "Scan parquet" in x.nodeName() and x.metrics().contains("numOutputRows"):
            metrics[x.nodeName()] = x.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in x.nodeName():
            stack.append(x.executedPlan())
        kids = x.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    some.collect()
    assert sum(metrics.values()) < 40_000
    assert catalog.by_ids(table, []).collect() == []
