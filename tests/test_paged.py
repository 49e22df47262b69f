"""Paged records: blocks to their end, failed ones marked and never passed, batch and stream."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import decoded, display_form, plain_ascii
from lodestar.operators import update
from lodestar.sources import papers
from lodestar.sources.paged import blocks, paged, write_pages


def put(root, block, pages):
    at = 0
    for rows in pages:
        folder = root / f"block={block}" / f"cursor={at}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(rows if isinstance(rows, str) else "\n".join(json.dumps(r) for r in rows))
        at += 1 if isinstance(rows, str) else len(rows)
    (root / f"block={block}").mkdir(exist_ok=True)


def months(tmp_path):
    put(tmp_path, "20230101_20230131", [[{"id": 1}, {"id": 2}], [{"id": 3, "é": None}]])
    put(tmp_path, "20230201_20230228", [])
    put(tmp_path, "20230301_20230331", [[{"id": 4}], "{torn"])
    put(tmp_path, "20230401_20230410", [[{"id": 5}]])
    return str(tmp_path)


def test_blocks():
    names = [b.name for b in blocks(date(2023, 11, 15), date(2024, 1, 2))]
    assert names == ["20231115_20231130", "20231201_20231231", "20240101_20240102"]
    assert [b.name for b in blocks(date(2024, 2, 28), date(2024, 3, 1), 2)] == ["20240228_20240229", "20240301_20240301"]
    assert blocks(date(2024, 2, 2), date(2024, 2, 1)) == []


def test_a_failed_block_is_not_passed(spark, tmp_path):
    rows = paged(spark, months(tmp_path), "2023-01-01", "2023-04-10")
    found = rows.collect()
    assert sorted(json.loads(r.record)["id"] for r in found if r.record) == [1, 2, 3, 5]
    assert {str(r.block_start): (r.position, r.ok) for r in found if r.record is None} == {"2023-01-01": (3, True), "2023-02-01": (0, True), "2023-03-01": (0, False), "2023-04-01": (1, True)}
    clock = update.advanced(rows.filter("record is null").withColumn("source", F.lit("s")))
    assert str(clock.first().until) == "2023-03-01"
    assert [r.position for r in found if r.record and r.block_start == date(2023, 1, 1)] == [0, 1, 2]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    root = tmp_path / "pages"
    put(root, "20230101_20230131", [[{"id": 1}, {"id": 2}]])

    def run():
        rows = paged(spark, str(root), "2023-01-01", "2023-04-30", stream=True).filter("record is not null")
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(json.loads(r.record)["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2]
    put(root, "20230201_20230228", [[{"id": 3}], [{"id": 4}]])
    put(root, "20230401_20230430", [[{"id": 9}]])
    # March isn't there yet, so April waits.
    assert run() == [1, 2, 3, 4]
    put(root, "20230301_20230331", [[{"id": 5}], "{torn"])
    with pytest.raises(Exception, match="20230301_20230331"):
        run()
    (root / "block=20230301_20230331" / "cursor=1" / "part-0.txt").write_text('{"id": 6}')
    assert run() == [1, 2, 3, 4, 5, 6, 9]


def test_written_pages(spark, tmp_path):
    rows = spark.createDataFrame([("20240101_20240131", i, f"v{i}\n") for i in range(45)], "block string, id long, v string")
    write_pages(rows, f"{tmp_path}/p", 20)
    got = paged(spark, f"{tmp_path}/p", "2024-01-01", "2024-01-31").filter("record is not null").collect()
    assert [json.loads(r.record) for r in sorted(got, key=lambda r: r.position)] == [{"id": i, "v": f"v{i}\n"} for i in range(45)]


def test_display_form_is_that_of_the_udf(spark):
    texts = ["a &lt;b&gt; c", "&amp;lt;i&amp;gt;", "x &#65;&#x42;&#233;&#xe9 &#99999999; y", "&lpar;z&rpar; &eacute;&hellip; &copy;", "no & sign &", "a &#; b &#x; c", "<i>t</i>  u\n v", "", None, "&excl;&quot;&apos;", "&#38;amp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", display_form(F.col("t")).alias("a"), plain_ascii(F.col("t")).alias("b"), decoded(F.col("t")).alias("d")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert [r.d for r in rows][-1] == "&amp;" and rows[8].d is None


def test_malformed_articles_cost_no_others(spark, tmp_path):
    good = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T&amp;C <b>{}</b></ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text("<Set>" + good.format(1, "x") + "<PubmedArticle><broken></PubmedArticle>" + good.format(2, "y") + "</Set>")
    (tmp_path / "b.xml").write_text("<Set><Other/></Set>")
    assert sorted((r.pmid, r.title, r.abstract, r.authors, r.date) for r in papers.pubmed_xml(spark, str(tmp_path)).collect()) == [("1", "T&C x", "", "", ""), ("2", "T&C y", "", "", "")]
    assert [(r.articles, r.failed) for r in papers.failed_articles(spark, str(tmp_path)).collect()] == [(3, 1)]
    plan = papers.pubmed_xml(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
