"""Queries that read what other systems leave behind: article XML and pages of records, made from the given tables in a folder of the query's own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import index, semmap, update
from ..session import shared_dir
from ..sources import catalog
from ..sources import papers as sources
from ..sources.paged import paged, write_pages
from .queries import PAPERS_SQL, POINTS_SQL, _cells, papers, query, table

#: Every fiftieth article lacks an end tag.
_BROKEN = "doc_id % 50 = 7"


def article_files(spark, sf_dir) -> str:
    """A folder of XML files with an article for each document."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    plain = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 80), "[^A-Za-z,.]+", " "))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name.split(' ')[0]}>"))
    i = F.col("doc_id").cast("string")
    month = F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Jul", "07"))), (F.col("doc_id") % 4 + 1).cast("int"))
    day = F.concat(tag("Year", F.lit("2011")), tag("Month", month), tag("Day", (F.col("doc_id") % 33).cast("string")))
    date = F.when(F.col("doc_id") % 3 == 0, tag("PubDate", day)).otherwise(tag("PubDate", tag("MedlineDate", F.concat(F.lit("Fall "), (F.col("doc_id") % 40 + 1980).cast("string")))))
    citation = F.concat(
        tag('PMID Version="3"', i), F.lit("<Article>"), tag("Journal", F.concat(tag("JournalIssue", date), tag("Title", F.lit("Full &amp; long")))),
        tag("ArticleTitle", F.concat(F.lit("On <i>"), plain, F.lit("</i>&amp;amp; more &#xE9;&#65;"))),
        tag("Abstract", F.concat(tag('AbstractText Label="AIMS"', F.concat(F.lit("We <b>saw</b> "), plain)), tag("AbstractText", F.lit("a &lt; b")))),
        tag("AuthorList", F.concat(tag("Author", F.concat(tag("LastName", F.col("lang")), tag("ForeName", F.lit("Ann")))), tag("Author", tag("CollectiveName", F.lit("G"))), tag("Author", tag("LastName", F.col("source"))))), F.lit("</Article>"),
        tag("MedlineJournalInfo", F.when(F.col("doc_id") % 2 == 0, tag("MedlineTA", F.lit("Short"))).otherwise("")),
        tag("MeshHeadingList", tag("MeshHeading", F.concat(tag("DescriptorName", F.lit(" Gas ")), tag("QualifierName", F.col("lang")), tag("QualifierName", F.lit("b"))))),
    )
    data = tag("PubmedData", tag("ArticleIdList", F.concat(tag('ArticleId IdType="pubmed"', i), tag('ArticleId IdType="doi"', F.concat(F.lit("10.1/"), i)))))
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), citation, F.when(F.expr(_BROKEN), "").otherwise("</MedlineCitation>"), data, F.lit("</PubmedArticle>"))
    path = f"{shared_dir(spark)}/lodestar/articles-{uuid.uuid4().hex}"
    d.withColumn("lang", F.coalesce("lang", F.lit("none"))).withColumn("source", F.coalesce("source", F.lit("none"))).select(xml).write.option("compression", "gzip").text(path)
    return path


_PLAIN_SQL = "trim(regexp_replace(substr(coalesce(text, ''), 1, 80), '[^A-Za-z,.]+', ' ', 'g'))"


@query(
    f"""with d as (select doc_id, {_PLAIN_SQL} as plain, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source from documents where not {_BROKEN})
 select cast(doc_id as varchar) as pmid, '3' as version, '10.1/' || doc_id as doi, trim(regexp_replace('On ' || plain || ' & more A', ' +', ' ', 'g')) as title, 'Ann ' || lang || '; ' || source as authors,
 case when doc_id % 3 = 0 then case doc_id % 4 when 1 then case when doc_id % 33 between 1 and 28 then '2011-02-' || lpad(cast(doc_id % 33 as varchar), 2, '0') else '2011-01-01' end
  when 2 then case when doc_id % 33 between 1 and 31 then '2011-07-' || lpad(cast(doc_id % 33 as varchar), 2, '0') else '2011-01-01' end else case when doc_id % 33 between 1 and 31 then '2011-01-' || lpad(cast(doc_id % 33 as varchar), 2, '0') else '2011-01-01' end end
  else cast(doc_id % 40 + 1980 as varchar) end as date, case when doc_id % 2 = 0 then 'Short' else 'Full & long' end as journal,
 'AIMS: ' || trim(regexp_replace('We saw ' || plain, ' +', ' ', 'g')) || chr(10) || 'a < b' as abstract, 'Gas [' || lang || ', b]' as mesh_terms from d"""
)
def article_xml(spark, sf_dir):
    """Articles of XML files as papers."""
    return sources.pubmed_xml(spark, article_files(spark, sf_dir)).select("pmid", "version", "doi", "title", "authors", "date", "journal", "abstract", "mesh_terms")


@query(f"select count(*) as articles, count(*) filter (where {_BROKEN}) as failed from documents")
def article_xml_counts(spark, sf_dir):
    """Articles, and those of them that can't be parsed."""
    found = sources.failed_articles(spark, article_files(spark, sf_dir))
    return found.agg(F.sum("articles").alias("articles"), F.sum("failed").alias("failed"))


def event_pages(spark, sf_dir) -> tuple[str, str, str]:
    """Pages of twenty events in blocks of three days."""
    e = table(spark, sf_dir, "events").filter("ts is not null and user_id % 5 = 0")
    first, last = e.agg(F.min(F.to_date("ts")).cast("string"), F.max(F.to_date("ts")).cast("string")).first()
    start = F.date_add(F.lit(first).cast("date"), (F.floor(F.datediff(F.to_date("ts"), F.lit(first).cast("date")) / 3) * 3).cast("int"))
    end = F.least(F.date_add(start, 2), F.lit(last).cast("date"))
    path = f"{shared_dir(spark)}/lodestar/pages-{uuid.uuid4().hex}"
    rows = e.select(F.concat_ws("_", F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd")).alias("block"), F.col("event_id").alias("id"), "user_id", "event_type")
    write_pages(rows, path, 20)
    return path, first, last


@query(
    """with e as (select *, cast(ts as date) as day, (select min(cast(ts as date)) from events where user_id % 5 = 0) as first, (select max(cast(ts as date)) from events where user_id % 5 = 0) as last from events where user_id % 5 = 0),
 b as (select *, first + cast((day - first) // 3 * 3 as integer) as block_start from e)
 select block_start, least(block_start + 2, last) as block_end, row_number() over (partition by block_start order by event_id) - 1 as position, event_id as id, event_type from b"""
)
def paged_records(spark, sf_dir):
    """All records of the blocks, page by page until an empty one."""
    path, first, last = event_pages(spark, sf_dir)
    rows = paged(spark, path, first, last, days=3).filter("record is not null")
    return rows.select("block_start", "block_end", "position", F.get_json_object("record", "$.id").cast("long").alias("id"), F.get_json_object("record", "$.event_type").alias("event_type"))


@query("select 'events' as source, max(cast(ts as date)) as until from events where user_id % 5 = 0")
def paged_clock(spark, sf_dir):
    """How far the clock moves by the blocks that were read to their end."""
    path, first, last = event_pages(spark, sf_dir)
    closing = paged(spark, path, first, last, days=3).filter("record is null")
    return update.advanced(closing.select(F.lit("events").alias("source"), "block_start", "block_end", "ok"))


_ONE_LINE_SQL = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(
    f"""select cast(doc_id as varchar) as id, {_ONE_LINE_SQL.format(c="substr(coalesce(text, ''), 1, 200)")} as title, 'A ' || doc_id as abstract, '' as authors, case when doc_id % 3 = 0 then '' else '2020-01-0' || (doc_id % 9 + 1) end as date,
 case when doc_id % 4 = 0 then null else lang end as categories, 'https://arxiv.org/abs/' || doc_id as doi, case when doc_id % 4 = 0 then 'arXiv' else coalesce(lang, 'arXiv') end as journal from documents where doc_id % 10 <> 9"""
)
def snapshot_lines(spark, sf_dir):
    """JSON Lines records: a tenth of the lines are torn, some fields are missing, some null."""
    d = table(spark, sf_dir, "documents")
    day = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("2020-01-0"), (F.col("doc_id") % 9 + 1).cast("string")))
    rows = d.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("title"), F.concat(F.lit(" A\n"), "doc_id").alias("abstract"), day.alias("update_date"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("categories"))).alias("value"))
    path = f"{shared_dir(spark)}/lodestar/lines-{uuid.uuid4().hex}"
    rows.select(F.when(F.col("doc_id") % 10 == 9, F.expr("substring(value, 1, 20)")).otherwise(F.col("value")).alias("value")).write.text(path)
    return sources.arxiv_snapshot(spark, path)


@query("select cast(doc_id as varchar) as doi, lang as server, case when n_chars is null then null else cast(n_chars as varchar) end as version, title from (select *, case when doc_id % 6 = 0 then null else 'T ' || doc_id end as title from documents)")
def preprint_arrays(spark, sf_dir):
    """Blocks of records as JSON arrays, a file each; every column is text and nulls stay null."""
    d = table(spark, sf_dir, "documents")
    record = F.to_json(F.struct(F.col("doc_id").alias("doi"), F.col("lang").alias("server"), F.col("n_chars").alias("version"), F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("T "), "doc_id")).alias("title")))
    path = f"{shared_dir(spark)}/lodestar/arrays-{uuid.uuid4().hex}"
    # Arrays of a hundred records at most.
    arrays = d.groupBy(F.floor(F.col("doc_id") / 100).alias("block")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    # A number of its own: a shuffle that is joined again by size has one task write all of the many small files.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    arrays.repartition(tasks, "block").select("value", "block").write.partitionBy("block").text(path)
    return sources.preprint_blocks(spark, f"{path}/*", ["doi", "server", "version", "title"])


@query(
    """with f as (select lang, source, count(*) as n from documents where lang is not null and source is not null group by lang, source), g as (select *, row_number() over (partition by lang order by source) as k, sum(n) over (partition by lang order by source) - n as s from f),
 c as (select *, dense_rank() over (order by lang) * 1000000 as base from g)
 select cast(base + s as bigint) as global_start, cast(base + s + n - 1 as bigint) as global_end, source as source_stem, cast(7 * k as bigint) as source_local_start from c"""
)
def chunk_intervals(spark, sf_dir):
    """Nested metadata of chunks, written and read as JSON, as a flat table of intervals."""
    f = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy("source")
    g = f.withColumn("k", F.row_number().over(w)).withColumn("s", F.sum("n").over(w) - F.col("n"))
    part = F.struct(F.col("s").alias("chunk_local_start"), (F.col("s") + F.col("n")).alias("chunk_local_end"), F.col("source").alias("source_stem"), (7 * F.col("k")).cast("long").alias("source_local_start"))
    chunks = g.groupBy("lang").agg(F.collect_list(part).alias("parts")).withColumn("base", F.dense_rank().over(Window.orderBy("lang")).cast("long") * 1000000)  # a row for each language
    meta = chunks.select(F.array(F.struct(F.col("base").alias("global_start"), "parts")).alias("chunks"))
    path = f"{shared_dir(spark)}/lodestar/metadata-{uuid.uuid4().hex}"
    meta.write.json(path)
    return index.intervals(spark.read.schema(meta.schema).json(path))


@query("select distinct source as stem from documents where source not in (select source from documents where lang in ('en', 'de') and doc_id % 40 < 13)")
def pending_files(spark, sf_dir):
    """Files that no run has taken: those queued, in work and done are known together; failed ones come again."""
    d = table(spark, sf_dir, "documents")
    state = F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "de", "in_progress").otherwise("failed")
    known = d.filter("doc_id % 40 < 13").select(F.col("source").alias("stem"), state.alias("state"))
    return index.pending(d.select(F.col("source").alias("stem")).distinct(), known.distinct())


@query("select url, regexp_extract(split_part(url, '/', -1), '^(.*?)(\\.[^.]*)?$', 1) as stem from pages")
def file_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", X.file_stem(F.col("url")).alias("stem"))


@query(f"with {POINTS_SQL}, e as (select distinct xi, yi from ce) select xi, yi, round(xl + (xi + 0.5) * (xh - xl) / 12, 9) as cx, round(yl + (yi + 0.5) * (yh - yl) / 12, 9) as cy from e, bo")
def grid_centers(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    at = semmap.centers(_cells(spark, sf_dir).select("xi", "yi").distinct(), semmap.bounds(points), 12)
    return at.select("xi", "yi", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query("select count(*) as total_rows from documents")
def metadata_rows(spark, sf_dir):
    """The rows of an index by its metadata file."""
    path = f"{shared_dir(spark)}/lodestar/meta-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total_rows")).write.json(path)
    return spark.range(1).select(F.lit(catalog.total_rows(spark, path)).alias("total_rows"))


@query(f"with {PAPERS_SQL} select source, corpus_id, date, title from papers union all select source, corpus_id, date, title from papers where corpus_id % 2 = 0")
def written_papers(spark, sf_dir):
    """Papers written twice by source, in files of bounded rows that are sorted by date, and read back."""
    p = papers(spark, sf_dir)
    path = f"{shared_dir(spark)}/lodestar/papers-{uuid.uuid4().hex}"
    for part in (p, p.filter("corpus_id % 2 = 0")):
        sources.write_papers(part, path)
    return spark.read.schema("corpus_id long, date string, title string, source string").parquet(path).select("source", "corpus_id", "date", "title")


@query(
    """with o as (select date_trunc('month', min(o_orderdate)) as a, max(cast(o_orderdate as date)) as b from orders), m as (select unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 month)) as s, b from o)
 select cast(s as date) as block_start, least(cast(s + interval 1 month - interval 1 day as date), b) as block_end, strftime(s, '%y%m%d') || '_' || strftime(least(cast(s + interval 1 month - interval 1 day as date), b), '%y%m%d') as name, (select count(*) from orders where cast(o_orderdate as date) between cast(s as date) and least(cast(s + interval 1 month - interval 1 day as date), b)) as orders from m"""
)
def fetch_blocks(spark, sf_dir):
    """The month blocks of a table's own range of dates, and the rows that each holds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    first, last = o.agg(F.trunc(F.min("day"), "month").cast("string"), F.max("day").cast("string")).first()
    held = o.groupBy(F.trunc("day", "month").alias("block_start")).agg(F.count(F.lit(1)).alias("orders"))
    return D.month_blocks(spark, first, last).join(held, "block_start", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
