import gzip
import json

import numpy as np

from lodestar.sources import catalog, papers
from lodestar.streaming.ingest import ingest_anti_join, ingest_new, sessions

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="2">11</PMID><DateCompleted><Year>2001</Year><Month>03</Month><Day>4</Day></DateCompleted><Article><Journal><JournalIssue><PubDate><Year>2000</Year><Month>Feb</Month><Day>30</Day></PubDate></JournalIssue><Title>Full Title</Title></Journal>
<ArticleTitle>On CO<sub>2</sub> &amp; air</ArticleTitle><Abstract><AbstractText Label="AIMS">We <i>saw</i> it.</AbstractText><AbstractText>More text.</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList><PublicationTypeList><PublicationType>Letter</PublicationType></PublicationTypeList></Article>
<MedlineJournalInfo><MedlineTA>Short</MedlineTA></MedlineJournalInfo><ChemicalList><Chemical><NameOfSubstance>Air</NameOfSubstance></Chemical></ChemicalList><MeshHeadingList><MeshHeading><DescriptorName>Gas</DescriptorName><QualifierName>a</QualifierName><QualifierName>b</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><broken></PubmedArticle>
</PubmedArticleSet>"""


def test_articles_of_xml(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(XML.encode()))
    got = {r.pmid: r for r in papers.pubmed_xml(spark, str(tmp_path)).collect()}
    assert set(got) == {"11", "12"}
    a = got["11"]
    assert (a.title, a.date, a.journal, a.authors, a.doi, a.version, a.type) == ("On CO 2 & air", "2000-01-01", "Short", "Ann Lee", "10.1/x", "2", "Letter")
    assert (a.abstract, a.mesh_terms, a.chemicals) == ("AIMS: We saw it.\nMore text.", "Gas [a, b]", "Air")
    assert got["12"].date == "1998" and got["12"].title == ""
    full = papers.pubmed_xml(spark, str(tmp_path), prefer_full_title=True).filter("pmid = '11'").first()
    assert full.journal == "Full Title"


def test_json_records(spark, tmp_path):
    rows = [{"id": "1", "title": "A\n b", "categories": None}, {"id": "2", "title": "É", "update_date": "2020-01-01", "categories": "cs"}]
    (tmp_path / "a.json").write_text("\n".join([json.dumps(rows[0]), "{broken", json.dumps(rows[1])]))
    got = {r.id: r for r in papers.arxiv_snapshot(spark, str(tmp_path / "a.json"), transliterate=True).collect()}
    assert (got["1"].title, got["1"].date, got["1"].journal, got["1"].doi) == ("A b", "", "arXiv", "https://arxiv.org/abs/1")
    assert (got["2"].title, got["2"].journal) == ("E", "cs")
    (tmp_path / "b.json").write_text(json.dumps([{"doi": "x", "n": 1}, {"doi": None, "n": 2}]))
    assert sorted(map(tuple, papers.preprint_blocks(spark, str(tmp_path / "b.json")).collect()), key=str) == sorted([("x", "1"), (None, "2")], key=str)


def test_packed_matrices(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (5, 48), dtype=np.uint8)
    for name, m in (("a", a), ("b", a[:, :40]), ("c", a[:0])):
        np.save(tmp_path / f"{name}.npy", m)
    got = papers.npy_codes(spark, str(tmp_path)).orderBy("local_idx").collect()
    assert [r.stem for r in got] == ["a"] * 5
    assert [[r[f"c{k}"] for k in range(6)] for r in got] == a.view(">i8").astype(np.int64).tolist()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"20{i % 30:02d}", "S") for i in range(100)], "id int, date string, source string")
    papers.write_papers(df, f"{tmp_path}/p", file_rows=10)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 100 and len(list((tmp_path / "p" / "source=S").glob("*.parquet"))) >= 10
    papers.write_lines(df.selectExpr("date as entry"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == 100


def test_streams_append_what_is_new(spark, tmp_path):
    for run, f in enumerate((ingest_new, ingest_anti_join)):
        source, target, at = (f"{tmp_path}/{run}{x}" for x in ("in", "out", "check"))
        spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string").coalesce(1).write.parquet(source)
        f(spark, source, "id int, v string", "id", target, at)
        assert spark.read.parquet(target).count() == 2
        spark.createDataFrame([(2, "d"), (3, "e")], "id int, v string").coalesce(1).write.mode("append").parquet(source)
        f(spark, source, "id int, v string", "id", target, at)
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_sessions(spark):
    events = spark.sql("select 1 as user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts from values (0), (4), (20) t(m)")
    assert sorted(r.n for r in sessions(events).collect()) == [1, 2]


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "corpus_id long, title string")
    df.coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    df.limit(3).coalesce(1).write.parquet(f"{tmp_path}/all.parquet")
    assert [catalog.papers_of(spark, str(tmp_path), *x).count() for x in (("a",), ("b", f"{tmp_path}/all.parquet"), ("b",), ("b", f"{tmp_path}/none"))] == [20, 3, 0, 0]
    (tmp_path / "meta.json").write_text(json.dumps({"total_rows": 41, "chunks": []}))
    (tmp_path / "other.json").write_text(json.dumps({"chunks": []}))
    assert [catalog.total_rows(spark, f"{tmp_path}/{x}.json") for x in ("meta", "other", "gone")] == [41, 0, 0]
    (tmp_path / "conf.json").write_text(json.dumps({"a": {"chunk_dir": "x", "password": "y"}, "b": None}))
    assert catalog.config(spark, f"{tmp_path}/conf.json") == {"a": {"chunk_dir": "x"}, "b": {}}
    part = catalog.row_range(spark.read.parquet(f"{tmp_path}/a.parquet"), 4, 3)
    assert sorted(r.corpus_id for r in part.collect()) == [4, 5, 6]
    assert "GreaterThanOrEqual(corpus_id,4)" in part._jdf.queryExecution().executedPlan().toString()
    codes = spark.createDataFrame([(i, "s", i) for i in range(9)], "id long, source string, c0 long")
    for some in (codes, codes.limit(0), codes.limit(2)):
        catalog.write_codes(some, f"{tmp_path}/codes", by="source")
    assert spark.read.schema(codes.schema).parquet(f"{tmp_path}/codes").count() == 11
    catalog.write_codes(codes.limit(0), f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").columns == codes.columns


def test_blocks_with_named_columns_are_read_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"doi": 5, "title": null},\n {"doi": "x", "more": 1, "title": "T"}]')
    from lodestar.sources.papers import preprint_blocks

    rows = preprint_blocks(spark, str(tmp_path), ["doi", "title"])
    assert sorted(map(tuple, rows.collect()), key=str) == [("5", None), ("x", "T")]
