"""The engine's own queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions import vectors as V
from ..operators import encode, index, search, semmap, update
from ..session import shared_dir
from ..sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: A document as a paper: identifiers, dates and journals are made from its id, the same way in SQL.
PAPER = {
    "source": "element_at(array('PubMed', 'BioRxiv', 'MedRxiv', 'arXiv'), cast(doc_id % 4 as int) + 1)",
    "corpus_id": "doc_id",
    "doi": "case doc_id % 5 when 0 then null when 1 then concat('10.1101/', cast(doc_id div 10 as string)) when 2 then concat('10.5555/', cast(doc_id div 3 as string)) when 3 then 'x' else concat('https://arxiv.org/abs/', cast(doc_id as string)) end",
    "title": "substring_index(text, '\\n', 1)",
    "authors": "concat('Lee,', lang, ' A; Roy ', source)",
    "date": "case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then cast(2000 + doc_id % 25 as string) else cast(date_add(date'2000-01-01', cast(doc_id * 3 % 9000 as int)) as string) end",
    "abstract": "text",
    "journal": "case doc_id % 6 when 0 then 'bioRxiv preprint' when 1 then 'MEDRXIV' when 2 then null else concat('Journal ', lang) end",
}
PAPERS_SQL = """papers as (select case doc_id % 4 when 0 then 'PubMed' when 1 then 'BioRxiv' when 2 then 'MedRxiv' else 'arXiv' end as source, doc_id % 4 as place, doc_id as corpus_id,
 case doc_id % 5 when 0 then null when 1 then '10.1101/' || (doc_id // 10) when 2 then '10.5555/' || (doc_id // 3) when 3 then 'x' else 'https://arxiv.org/abs/' || doc_id end as doi,
 split_part(text, chr(10), 1) as title, 'Lee,' || lang || ' A; Roy ' || source as authors,
 case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then cast(2000 + doc_id % 25 as varchar) else cast(cast(date '2000-01-01' + cast(doc_id * 3 % 9000 as integer) as date) as varchar) end as date,
 text as abstract, case doc_id % 6 when 0 then 'bioRxiv preprint' when 1 then 'MEDRXIV' when 2 then null else 'Journal ' || lang end as journal from documents)"""
DAY_SQL = "coalesce(case when regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') then try_cast(date as date) end, case when regexp_full_match(date, '\\d{4}') then try_cast(date || '-01-01' as date) end)"
DIST_SQL = "list_sum(list_transform(range(1, 65), lambda i: cast(({a}[i] > 0) <> ({b}[i] > 0) as integer)))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(F.expr(e).alias(c) for c, e in PAPER.items()))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("chunk_id"), *V.pack("embedding"))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes as an index has them: written once in an application, then read."""
    made, key = codes(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/lodestar/codes-{uuid.uuid4().hex}"
        catalog.write_codes(made, path)
        _STORED[key] = path
    return spark.read.schema(made.schema).parquet(_STORED[key])


_KEYED: dict[tuple[str, str], DataFrame] = {}


def keyed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers as an index has them: bucketed by key, written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEYED:
        _KEYED[key] = catalog.write_papers_by_key(papers(spark, sf_dir), f"{shared_dir(spark)}/lodestar/papers-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _KEYED[key]


def first_query(c: DataFrame) -> list[int]:
    return [c.filter("id = 0").select("c0").first()[0]]


HITS_SQL = f"q as (select embedding as qe from embeddings where vec_id = 0), h as (select vec_id as id, label as chunk_id, cast({DIST_SQL.format(a='embedding', b='qe')} as integer) as dist from embeddings, q)"


@query(f"with {HITS_SQL} select id, dist, 1.0 - dist / 64.0 as score from h order by dist, id limit 10")
def hamming_topk(spark, sf_dir):
    c = stored(spark, sf_dir)
    return search.topk(c, first_query(c), 10).select("id", "dist", "score")


@query(f"with {HITS_SQL} select id, chunk_id, dist, rank from (select *, cast(row_number() over (partition by chunk_id order by dist, id) as integer) as rank from h) where rank <= 5")
def hamming_topk_per_chunk(spark, sf_dir):
    c = stored(spark, sf_dir)
    return search.topk_per_chunk(c, first_query(c), 5).select("id", "chunk_id", "dist", "rank")


@query(
    f"""select query_id, id, dist, rank from (select *, row_number() over (partition by query_id order by dist, id) as rank from (
 select q.vec_id as query_id, e.vec_id as id, cast({DIST_SQL.format(a="e.embedding", b="q.embedding")} as bigint) as dist from embeddings e, embeddings q where q.vec_id % 100 = 0)) where rank <= 10"""
)
def knn_graph(spark, sf_dir):
    """Nearest neighbours of the stated queries, ids divisible by 100, among all rows."""
    c = stored(spark, sf_dir)
    return search.knn(c, c.filter("id % 100 = 0"), 10).select("query_id", "id", "dist", F.col("rank").cast("long").alias("rank"))


@query(
    f"""select query_id, id, dist, rank from (select *, row_number() over (partition by query_id order by dist, id) as rank from (
 select q.vec_id as query_id, e.vec_id as id, cast({DIST_SQL.format(a="e.embedding", b="q.embedding")} as bigint) as dist from embeddings e, embeddings q where q.vec_id % 100 = 0)) where rank <= 50"""
)
def multi_query_topk(spark, sf_dir):
    """The fifty nearest of each stated query, all in one reading of the codes."""
    c = stored(spark, sf_dir)
    return search.knn(c, c.filter("id % 100 = 0"), 50).select("query_id", "id", "dist", F.col("rank").cast("long").alias("rank"))


HALF_SQL = "cast(list_sum(list_transform(range({a}, {b}), lambda i: case when embedding[i] > 0 then 1::bigint << ({b} - 1 - i) else 0 end)) as bigint)"


@query(f"select vec_id as id, {HALF_SQL.format(a=1, b=33)} as high, {HALF_SQL.format(a=33, b=65)} as low, cast(list_sum(list_transform(embedding, lambda x: cast(x > 0 as integer))) as integer) as ones from embeddings")
def quantize_popcount(spark, sf_dir):
    c = codes(spark, sf_dir)
    return c.select("id", F.shiftrightunsigned("c0", 32).alias("high"), F.col("c0").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.bit_count("c0").cast("int").alias("ones"))


@query("select vec_id as id, list_transform(embedding, lambda x: case when x > 0 then 1.0::float else 0.0::float end) as bits from embeddings")
def unpack_bits(spark, sf_dir):
    return codes(spark, sf_dir).select("id", V.unpack(F.col("c0")).alias("bits"))


@query(
    f"""with p as (select a.vec_id, 1.0 - {DIST_SQL.format(a="a.embedding", b="b.embedding")} / 64.0 as s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
 select count(*) as n, round(avg(s), 9) as avg_sim, min(s) as min_sim, max(s) as max_sim, min(s) >= 0.3 as ok from p"""
)
def integrity_similarity(spark, sf_dir):
    """Codes of even ids against those of the ids after them."""
    c = codes(spark, sf_dir).select("id", "c0")
    fresh = c.filter("id % 2 = 1").withColumn("id", F.col("id") - 1)
    return index.integrity(c.filter("id % 2 = 0"), fresh, 0.3).withColumn("avg_sim", F.round("avg_sim", 9))


@query("select vec_id as id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))), 6) as norm, 1.0::double as unit from embeddings")
def normalize_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return e.select(F.col("vec_id").alias("id"), F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(norm(V.normalized(F.col("embedding"))), 6).alias("unit"))


DEDUP_SQL = """k as (select *, trim(coalesce(doi, 'None')) as d, lower(regexp_replace(coalesce(title, 'None'), '^\\s+|\\s+$', '', 'g')) as t from ranked),
 a as (select * from (select *, case when length(d) > 5 then row_number() over (partition by d order by rank) else 1 end as n1 from k) where n1 = 1),
 b as (select * from (select *, case when length(d) >= 5 or t = '' then 1 else row_number() over (partition by t order by rank) end as n2 from a) where n2 = 1)"""


@query(f"with {PAPERS_SQL}, ranked as (select *, corpus_id as rank from papers), {DEDUP_SQL} select corpus_id, doi, title from b")
def live_dedup(spark, sf_dir):
    return search.live_dedup(papers(spark, sf_dir).withColumn("rank", F.col("corpus_id"))).select("corpus_id", "doi", "title")


PIPE_SQL = f"""with {PAPERS_SQL}, {HITS_SQL},
 hits as (select *, row_number() over (partition by id % 4, chunk_id order by dist, id) as rn from h),
 ranked as (select p.*, dist, 1.0 - dist / 64.0 as score, row_number() over (order by dist, place, corpus_id) as rank from hits join papers p on p.corpus_id = id where rn <= {{pool}} and length(abstract) > 75 and {DAY_SQL} between date '2001-01-01' and date '2022-12-31'),
 {DEDUP_SQL}, top as (select * from b order by rank limit 10),
 r as (select *, case when source = 'PubMed' and lower(journal) like '%biorxiv%' then 'BioRxiv' when source = 'PubMed' and lower(journal) like '%medrxiv%' then 'MedRxiv' else source end as s2 from top)
 select doi, title, authors, date, abstract, score, case when s2 = 'PubMed' and regexp_matches(doi, '10.1101') then 'BioRxiv' else s2 end as source, journal, corpus_id from r"""


def _search(spark: SparkSession, sf_dir: str, per_chunk: int | None = None) -> DataFrame:
    c = stored(spark, sf_dir)
    where = c.withColumn("corpus_id", F.col("id")).withColumn("source", F.element_at(F.array(*map(F.lit, search.SOURCES)), (F.col("id") % 4).cast("int") + 1)).drop("id")
    return search.search(where, keyed_papers(spark, sf_dir), first_query(c), 10, "2001-01-01", "2022-12-31", True, per_chunk, by_key=True)


@query(PIPE_SQL.replace("{pool}", str(search.raw_limit(10))))
def search_pipeline(spark, sf_dir):
    return _search(spark, sf_dir)


@query(PIPE_SQL.replace("{pool}", "20"))
def search_small_pool(spark, sf_dir):
    """The same with twenty hits a chunk."""
    return _search(spark, sf_dir, per_chunk=20)


@query("select min(doc_id) as doc_id, text from documents group by text, source")
def exact_drop_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_stem"), F.col("doc_id").alias("pos"))
    return index.drop_repeats(d, ("text",)).select("doc_id", "text")


@query("select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1996-12-31'")
def date_range_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # The bounds are on the stored column, so they reach the scan.
    return o.filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query(f"with {PAPERS_SQL} select corpus_id, date from papers where {DAY_SQL} between date '2005-01-01' and date '2010-06-30'")
def paper_date_filter(spark, sf_dir):
    return search.within_dates(papers(spark, sf_dir), "2005-01-01", "2010-06-30").select("corpus_id", "date")


@query(f"with {PAPERS_SQL} select corpus_id from papers where title is not null and title <> '' and length(abstract) > 75")
def quality_filter(spark, sf_dir):
    return search.strict_map_rows(papers(spark, sf_dir)).select("corpus_id")


@query(
    f"""with {PAPERS_SQL}, r as (select *, case when source = 'PubMed' and lower(journal) like '%biorxiv%' then 'BioRxiv' when source = 'PubMed' and lower(journal) like '%medrxiv%' then 'MedRxiv' else source end as s from papers)
 select corpus_id, case when s = 'PubMed' and regexp_matches(doi, '10.1101') then 'BioRxiv' else s end as source from r"""
)
def journal_relabel(spark, sf_dir):
    return papers(spark, sf_dir).select("corpus_id", search.relabelled(F.col("source"), F.col("journal"), F.col("doi")).alias("source"))


@query(
    """select cast(doc_id as varchar) as doi, lang as journal, '2020-01-01' as date, text as abstract, 'A' as source from documents
 union all select cast(page_id as varchar), url, null, html, 'B' from pages union all select cast(item_id as varchar), null, '1999', text, 'C' from benchmark"""
)
def harmonize_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doi"), F.col("lang").alias("Server"), F.lit("2020-01-01").alias("update_date"), F.col("text").alias("abstract"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doi"), F.col("url").alias("journal-ref"), F.col("html").alias("abstract"))
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doi"), F.lit("1999").alias("posted"), F.col("text").alias("abstract"))
    out = search.harmonized(a, "A").unionByName(search.harmonized(b, "B")).unionByName(search.harmonized(c, "C"))
    return out.select("doi", "journal", "date", "abstract", "source")


COUNTS_SQL = "f as (select source as stem, count(*) as rows from documents group by source)"


@query(f"with {COUNTS_SQL} select stem, rows, cast(coalesce(sum(rows) over (order by stem rows between unbounded preceding and 1 preceding), 0) as bigint) as global_start, cast(sum(rows) over (order by stem) - 1 as bigint) as global_end from f")
def running_offsets(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stem")).agg(F.count(F.lit(1)).alias("rows"))
    return index.offsets(f)


@query(
    f"""with {COUNTS_SQL}, o as (select stem, sum(rows) over (order by stem) - rows as s, sum(rows) over (order by stem) - 1 as e from f)
 select doc_id as corpus_id, stem as source_stem, cast(doc_id - s as bigint) as local_idx from documents join o on doc_id between s and e"""
)
def interval_lookup(spark, sf_dir):
    spans = running_offsets(spark, sf_dir).select("global_start", "global_end", F.col("stem").alias("source_stem"), F.lit(0).cast("long").alias("source_local_start"))
    return index.located(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id")), spans)


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def ingest_anti_join_id(spark, sf_dir):
    return index.new_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("with s as (select doc_id, split_part(text, chr(10), 1) || text as sig from documents) select doc_id from s where sig not in (select sig from s where doc_id % 3 = 0)")
def ingest_anti_join_signature(spark, sf_dir):
    p = papers(spark, sf_dir)
    return index.new_papers(p, p.filter("corpus_id % 3 = 0")).select(F.col("corpus_id").alias("doc_id"))


@query("select doc_id as stem, doc_id in (select vec_id from embeddings) as paired from documents")
def paired_missing(spark, sf_dir):
    return index.paired(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stem")))


@query("select count(*) as files, count(*) filter (where doc_id in (select vec_id from embeddings)) as paired, count(*) filter (where doc_id not in (select vec_id from embeddings)) as missing from documents")
def health_report(spark, sf_dir):
    return index.health(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stem")))


@query(
    """with c as (select user_id as stem, epoch_us(max(ts)) / 1e6 as mtime from events where ts >= timestamp '2024-01-10' group by user_id), r as (select user_id as stem, epoch_us(max(ts)) / 1e6 as mtime from events where ts < timestamp '2024-01-20' group by user_id)
 select c.stem, case when r.stem is null then 'new' when c.mtime > r.mtime + 1.0 then 'modified' else 'same' end as change from c left join r using (stem)"""
)
def file_change_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = lambda df: df.groupBy(F.col("user_id").alias("stem")).agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6).alias("mtime"))
    return index.changed(last(e.filter("ts >= timestamp'2024-01-10'")), last(e.filter("ts < timestamp'2024-01-20'")))


@query("with s as (select user_id, max(epoch_us(ts) // 1000000) as last_seen from events group by user_id) select count(*) filter (where last_seen >= (select max(last_seen) from s) - 86400) as active from s")
def active_users(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("last_seen"))
    now = e.agg(F.max("last_seen")).first()[0]
    return index.active_users(e, F.lit(now), 86400)


@query("with g as (select user_id, ts, case when ts <= lag(ts) over w + interval 300 second then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(*) as n, max(ts) + interval 300 second as \"end\" from s group by user_id, k")
def session_windows(spark, sf_dir):
    from ..streaming.ingest import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", "n", "end")


@query("select coalesce(source, 'all') as source, count(*) as n from documents group by rollup (source)")
def source_totals(spark, sf_dir):
    return index.totals(table(spark, sf_dir, "documents"))


@query("select event_type as state, count(*) as n from events group by event_type")
def queue_states(spark, sf_dir):
    return index.queue_states(table(spark, sf_dir, "events").select(F.col("event_type").alias("state")))


@query(
    """with recursive f as (select lang as source, source as stem, count(*) as rows, row_number() over (partition by lang order by source) as k from documents group by lang, source),
 p as (select source, stem, rows, k, cast(0 as bigint) as chunk_id, rows as used from f where k = 1 union all
 select f.source, f.stem, f.rows, f.k, case when p.used + f.rows <= 60 then p.chunk_id else p.chunk_id + 1 end, case when p.used + f.rows <= 60 then p.used + f.rows else f.rows end from p join f on f.source = p.source and f.k = p.k + 1)
 select source, stem, rows, chunk_id from p"""
)
def chunk_packing(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source"), F.col("source").alias("stem")).agg(F.count(F.lit(1)).alias("rows"))
    return index.packed(f, 60).select("source", "stem", "rows", "chunk_id")


@query("select o_orderkey, cast(o_orderdate as date) as day, rank from (select *, row_number() over (order by cast(o_orderdate as date) desc, o_orderkey) as rank from orders) where rank <= 100")
def result_sort_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    top = search.ordered(o, "date", ("o_orderkey",)).limit(100)
    rank = F.row_number().over(_over_all(F.col("day").desc(), "o_orderkey"))
    return top.withColumn("day", F.col("date").cast("date")).withColumn("rank", rank.cast("long")).select("o_orderkey", "day", "rank")


def _over_all(*order):
    """A window over the few rows of a top-k result."""
    return Window.orderBy(*order)


@query(
    f"""with {PAPERS_SQL}, c as (select 'https://arxiv.org/abs/' || o_custkey as doi, count(*) as n from orders group by 1 union all select '10.5555/' || o_custkey, count(*) from orders group by 1)
 select corpus_id, doi, case when doi is null or doi = '' or lower(doi) like '%arxiv%' then 0 else coalesce(n, 0) end as citations from papers left join c using (doi)"""
)
def citation_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    known = n.select(F.explode(F.array(F.concat(F.lit("https://arxiv.org/abs/"), "o_custkey"), F.concat(F.lit("10.5555/"), "o_custkey"))).alias("doi"), "n")
    return search.with_citations(papers(spark, sf_dir), known).select("corpus_id", "doi", "citations")


@query(
    f"""with {PAPERS_SQL} select corpus_id, case when source = 'PubMed' then case when doi like '%10.%' then 'https://doi.org/' || doi end when doi like '%arxiv.org%' then doi when length(doi) > 0 then 'https://doi.org/' || doi end as full_text,
 case when doi like '%arxiv.org%' then doi else 'https://doi.org/' || doi end as display,
 case when doi is null then '' when doi like '%arxiv.org%' then doi when regexp_extract(doi, '(10\\.\\d{{4,9}}/\\S+)', 1) <> '' then regexp_extract(doi, '(10\\.\\d{{4,9}}/\\S+)', 1) else doi end as clean from papers"""
)
def full_text_link(spark, sf_dir):
    p, doi = papers(spark, sf_dir), F.col("doi")
    return p.select("corpus_id", X.full_text_link(F.col("source"), doi).alias("full_text"), X.doi_link(doi).alias("display"), X.clean_doi(doi).alias("clean"))


BIB_SQL = """select corpus_id as idx, '@article{' || coalesce(nullif(regexp_replace(split_part(split_part(au, ' ', 1), ',', 1), '[^\\p{L}\\p{N}_]+', '', 'g'), ''), 'Anon') || yr || coalesce(nullif(regexp_extract(regexp_replace(title, '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\S+', 0), ''), 'Untitled') || '_' || corpus_id || ',' || chr(10)
 || '  author = {' || au || '},' || chr(10) || '  title = {' || title || '},' || chr(10) || '  journal = {' || jo || '},' || chr(10) || '  year = {' || yr || '},' || chr(10)
 || case when doi like '%10.%' then '  doi = {' || doi || '},' || chr(10) || '  url = {https://doi.org/' || doi || '},' || chr(10) else '' end || '}' || chr(10) as entry
 from (select *, replace(authors, ';', ' and') as au, coalesce(nullif(regexp_extract(coalesce(date, ''), '\\d{4}', 0), ''), 'n.d.') as yr, coalesce(journal, upper(source[1]) || lower(source[2:])) as jo from papers)"""


@query(f"with {PAPERS_SQL} {BIB_SQL}")
def bibtex_export(spark, sf_dir):
    return X.bibtex(papers(spark, sf_dir).withColumnRenamed("corpus_id", "idx"))


@query(f"with {PAPERS_SQL} select string_agg('[' || corpus_id || '] ' || title || chr(10) || abstract, chr(10) || chr(10) order by corpus_id) as context from papers where corpus_id < 8")
def prompt_context(spark, sf_dir):
    return X.prompt_context(papers(spark, sf_dir).withColumnRenamed("corpus_id", "rank"), 8)


@query("select conv_id, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || text, chr(10) order by turn) as history from conversations group by conv_id")
def chat_history(spark, sf_dir):
    return X.chat_history(table(spark, sf_dir, "conversations"))


@query("select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')[1:4] as questions from documents")
def question_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.questions(F.col("text")).alias("questions"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as line, '. ' || text as embedded from documents")
def clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.one_line(F.col("text")).alias("line"), X.embedding_text(F.lit(None), F.col("text")).alias("embedded"))


@query(
    """select page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', '', 'g'), '[^\\x20-\\x7E]', '', 'g'), ' +', ' ', 'g')) as plain from pages"""
)
def format_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_ascii(F.col("html"), full=False).alias("plain"))


@query(
    """select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '&(copy|middot|nbsp);', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g'), '<[^>]+>', '', 'g'), '[^\\x20-\\x7E]', '', 'g'), ' +', ' ', 'g')) as plain from pages"""
)
def format_text_full(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_ascii(F.col("html")).alias("plain"))


@query(
    """select o_orderkey, case when o_orderkey % 4 = 0 then coalesce(regexp_extract('1998 Nov', '\\b((?:19|20)\\d{2})\\b', 1), '') when try_cast(y || '-' || m || '-' || d as date) is not null then y || '-' || m || '-' || d else y || '-01-01' end as date from
 (select o_orderkey, strftime(o_orderdate, '%Y') as y, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%m') else '01' end as m, case when o_orderkey % 5 = 0 then '31' else strftime(o_orderdate, '%d') end as d from orders)"""
)
def date_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    year = F.when(k % 4 != 0, F.date_format(day, "yyyy"))
    month = F.when(k % 3 == 0, F.date_format(day, "MMM")).otherwise(F.date_format(day, "MM"))
    second = (F.when(k % 2 == 0, year), month, F.when(k % 5 == 0, F.lit("31")).otherwise(F.date_format(day, "d")))
    first = (F.when(k % 2 == 1, year), second[1], second[2])
    return o.select("o_orderkey", D.cascade([first, second], F.lit("1998 Nov-Dec")).alias("date"))


@query(
    """select cast(s as date) as block_start, cast(least(s + interval 1 month - interval 1 day, date '2024-03-15') as date) as block_end, strftime(s, '%y%m%d') || '_' || strftime(least(s + interval 1 month - interval 1 day, date '2024-03-15'), '%y%m%d') as name
 from (select unnest(generate_series(date '2013-01-01', date '2024-03-15', interval 1 month)) as s)"""
)
def month_blocks(spark, sf_dir):
    return D.month_blocks(spark, "2013-01-01", "2024-03-15")


POINTS_SQL = "pt as (select vec_id as id, label % 4 as source, embedding[1]::double as x, embedding[2]::double as y from embeddings), bo as (select min(x) - 0.05 * (max(x) - min(x)) as xl, max(x) + 0.05 * (max(x) - min(x)) as xh, min(y) - 0.05 * (max(y) - min(y)) as yl, max(y) + 0.05 * (max(y) - min(y)) as yh from pt), ce as (select pt.*, cast(floor((x - xl) / (xh - xl) * 12) as integer) as xi, cast(floor((y - yl) / (yh - yl) * 12) as integer) as yi from pt, bo)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("source"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return semmap.gridded(points, semmap.bounds(points), 12).select("id", "source", "x", "y", "xi", "yi")


@query(f"with {POINTS_SQL}, c as (select cast(source as varchar) as source, xi, yi, count(*) as n from ce group by all union all select 'all', xi, yi, count(*) from ce group by xi, yi) select source, xi, yi, n, round(ln(1 + n), 9) as log_n from c")
def grid_histogram(spark, sf_dir):
    return semmap.histogram(_cells(spark, sf_dir).withColumn("source", F.col("source").cast("string"))).withColumn("log_n", F.round("log_n", 9))


@query(f"with {POINTS_SQL} select xi, yi, id, source from (select *, row_number() over (partition by xi, yi order by source, id) as k from ce) where k = 1")
def grid_representative_first(spark, sf_dir):
    return semmap.representatives(_cells(spark, sf_dir), ["source", "id"]).select("xi", "yi", "id", "source")


@query(f"with {POINTS_SQL} select xi, yi, id, source from (select *, row_number() over (partition by xi, yi order by source desc, id desc) as k from ce) where k = 1")
def grid_representative_last(spark, sf_dir):
    return semmap.representatives(_cells(spark, sf_dir), ["source", "id"], last=True).select("xi", "yi", "id", "source")


LABEL_SQL = "'<b>' || case when length(title) > 100 then title[1:100] || '...' else title end || '</b><br>(' || case when length(date) > 0 then date[1:4] else 'n.d.' end || ') ' || p.source"


@query(f"with {PAPERS_SQL}, {POINTS_SQL} select xi, yi, id, {LABEL_SQL} as label from (select *, row_number() over (partition by xi, yi order by source, id) as k from ce) c join papers p on p.corpus_id = c.id where k = 1")
def grid_labels(spark, sf_dir):
    best = semmap.representatives(_cells(spark, sf_dir), ["source", "id"]).select("xi", "yi", "id")
    return best.join(papers(spark, sf_dir), F.col("id") == F.col("corpus_id")).select("xi", "yi", "id", semmap.cell_label(F.col("title"), F.col("date"), F.col("source")).alias("label"))


@query(f"with {PAPERS_SQL} select corpus_id, coalesce({DAY_SQL}, (select min({DAY_SQL}) from papers)) as day, round(ln(1 + case when corpus_id % 3 = 0 then 0 else corpus_id % 50 end) * 5 + 5, 9) as marker_size from papers")
def scatter_projection(spark, sf_dir):
    p = papers(spark, sf_dir).select("corpus_id", D.paper_date(F.col("date")).alias("day"), F.when(F.col("corpus_id") % 3 != 0, F.col("corpus_id") % 50).alias("citations"))
    return semmap.scatter(p).select("corpus_id", "day", F.round("marker_size", 9).alias("marker_size"))


MIXED_SQL = "md5(vec_id || '-42')"


@query(
    f"""with c as (select label, count(*) as n, (select count(*) from embeddings) as total from embeddings group by label),
 r as (select vec_id as id, e.label as chunk_id, {MIXED_SQL} as h, row_number() over (partition by e.label order by {MIXED_SQL}, vec_id) as k, greatest(1, n * 100 // total) as take from embeddings e join c on c.label = e.label)
 select id, chunk_id from r where k <= take order by h, id limit 100"""
)
def stratified_sample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chunk_id"))
    return semmap.stratified(e, 100)


@query(f"select vec_id, label from embeddings where cast('0x' || substr({MIXED_SQL}, 1, 13) as bigint) / cast(4503599627370496 as double) < 100.0 / (select count(*) from embeddings) order by {MIXED_SQL}, vec_id limit 100")
def bernoulli_sample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return semmap.bernoulli(e.select("vec_id", "label"), 100, e.count(), key="vec_id")


@query(
    """with e as (select l_suppkey % 50 as head, l_partkey % 40 as tail, sum(l_quantity) as weight from lineitem group by 1, 2), k as (select * from e where weight >= (select max(weight) from e) / 2.0)
 select head, tail, weight, cast(floor(weight * 2) as integer) as repeats from k"""
)
def edge_weights(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("head"), (F.col("l_partkey") % 40).alias("tail"), F.col("l_quantity").alias("weight"))
    return semmap.edge_weights(e, 2)


@query()
def pca_projection(spark, sf_dir):
    return semmap.pca_projection(table(spark, sf_dir, "embeddings"), id_="vec_id")


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.missing'), '') as missing from events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' codes by the stand-in encoder, made once in an application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/texts")
    schema = "id long, c0 long, c1 long"
    if key not in _STORED:
        path = f"{shared_dir(spark)}/lodestar/text-codes-{uuid.uuid4().hex}"
        rows = encode.encoded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"), limbs=2)
        catalog.write_codes(rows.select("id", "c0", "c1"), path)
        _STORED[key] = path
    return spark.read.schema(schema).parquet(_STORED[key])


@query()
def text_search(spark, sf_dir):
    """Documents by their hashed codes: the first benchmark item is the query text."""
    text = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]
    return search.topk(text_codes(spark, sf_dir), encode.query_code(spark, text, limbs=2), 10).select("id", "dist", "score")


@query()
def text_search_all(spark, sf_dir):
    """The ten documents nearest to each document of the stated query set, by their hashed codes, in one reading."""
    c = text_codes(spark, sf_dir)
    return search.knn(c, c.filter("id % 100 = 0"), 10).select("query_id", "id", "dist", F.col("rank").cast("long").alias("rank"))


@query("select distinct doc_id, text from documents")
def stream_dedup_ingest(spark, sf_dir):
    """Documents through a stream that ends when all is read: keys never seen before are appended."""
    from ..streaming.ingest import ingest_new

    root = f"{shared_dir(spark)}/lodestar/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows.write.parquet(f"{root}/in")
    ingest_new(spark, f"{root}/in", rows.schema, "doc_id", f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@query("select o_orderkey, citations, rank from (select o_orderkey, citations, row_number() over (order by citations desc nulls last, o_orderkey) as rank from (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_custkey % 97 end as citations from orders)) where rank <= 100")
def result_sort_citations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 97).alias("citations"), F.lit(0.0).alias("score"), F.lit("").alias("date"))
    top = search.ordered(o, "citations", ("o_orderkey",)).limit(100)
    rank = F.row_number().over(_over_all(F.col("citations").desc_nulls_last(), "o_orderkey"))
    return top.select("o_orderkey", "citations", rank.cast("long").alias("rank"))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as title from pages")
def html_title_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.title_text(F.col("html")).alias("title"))


@query(f"with {PAPERS_SQL} select source, count(case when source = 'PubMed' then case when doi like '%10.%' then doi end when doi like '%arxiv.org%' then doi when length(doi) > 0 then doi end) as full_texts, count(*) as papers from papers group by source")
def full_text_count(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.groupBy("source").agg(F.count(X.full_text_link(F.col("source"), F.col("doi"))).alias("full_texts"), F.count(F.lit(1)).alias("papers"))


@query("select doc_id, case when source = 'src1' then 'Represent this: ' when source = 'src2' then 'Find: ' else '' end || '. ' || text as embedded from documents")
def source_instructions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(X.source_prefix(F.col("source"), {"src1": "Represent this: ", "src2": "Find: "}), X.embedding_text(F.lit(None), F.col("text"))).alias("embedded"))


@query("select doc_id, source from documents where doc_id >= 100 and doc_id < 160")
def row_range(spark, sf_dir):
    """The rows of a chunk, by the range of its ids."""
    return catalog.row_range(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 60, "doc_id")


SUMMARY, QUESTIONS = "Sum up what these papers have in common and where they differ.", "Ask three questions about these abstracts, one on each line."


@query(
    f"""with {PAPERS_SQL} select '{SUMMARY}' || chr(10) || chr(10) || string_agg('Paper ' || corpus_id || ': ' || title || chr(10) || 'Abstract: ' || abstract, chr(10) || chr(10) order by corpus_id) as prompt from papers where corpus_id < 8
 union all select '{QUESTIONS}' || chr(10) || chr(10) || string_agg(title || chr(10) || abstract, chr(10) order by corpus_id) from papers where corpus_id < 8"""
)
def paper_prompts(spark, sf_dir):
    ranked = papers(spark, sf_dir).withColumnRenamed("corpus_id", "rank")
    return X.paper_prompt(ranked, SUMMARY).unionByName(X.paper_prompt(ranked, QUESTIONS, labelled=False))


@query(
    f"""with {PAPERS_SQL}, c as (select string_agg('[' || corpus_id || '] ' || title || chr(10) || abstract, chr(10) || chr(10) order by corpus_id) as context from papers where corpus_id < 3),
 h as (select conv_id, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || text, chr(10) order by turn) as history from conversations group by conv_id)
 select conv_id, 'Answer from the abstracts.' || chr(10) || chr(10) || context || chr(10) || chr(10) || history || chr(10) || 'User: Why?' || chr(10) || 'Assistant:' as prompt from h, c"""
)
def chat_prompt(spark, sf_dir):
    return X.chat_prompt(table(spark, sf_dir, "conversations"), papers(spark, sf_dir).withColumnRenamed("corpus_id", "rank"), "Answer from the abstracts.", "Why?", n=3)


LOSS_SQL = "least({x}, 0.0) - ln(1 + exp(-abs({x})))"


@query(
    f"""with e as (select l_orderkey, l_linenumber, l_discount * 10 as w, -ln(1 + pow(l_quantity / 10, 2)) as o from lineitem), s as (select *, {LOSS_SQL.format(x="o")} as ls from e)
 select l_orderkey, l_linenumber, round(o, 9) as odds, round(-w * ls - (1 - w) * (ls - o), 9) as loss from s"""
)
def map_loss(spark, sf_dir):
    """Cross entropy of graph weights and distances on a map."""
    odds = semmap.nearness(F.col("l_quantity") / 10)
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("w"), odds.alias("o"))
    return e.select("l_orderkey", "l_linenumber", F.round("o", 9).alias("odds"), F.round(semmap.map_loss(F.col("w"), F.col("o")), 9).alias("loss"))


def _layers() -> list:
    made = lambda n, m, by: ((np.arange(n)[:, None] * by + np.arange(m) * 3) % 11 - 5) / 8
    return [(made(64, 4, 7), np.array([0.1, -0.1, 0.2, 0.0])), (made(4, 2, 5), np.array([0.5, -0.5]))]


_HIDDEN_SQL = ", ".join(f"greatest(0.0, {b} + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * (((i - 1) * 7 + {3 * j}) % 11 - 5) / 8.0))) as h{j}" for j, b in enumerate((0.1, -0.1, 0.2, 0.0)))
_OUT_SQL = ", ".join(f"round({b} + {' + '.join(f'h{i} * ({((i * 5 + 3 * j) % 11 - 5) / 8})' for i in range(4))}, 6) as {c}" for j, (b, c) in enumerate(((0.5, "x"), (-0.5, "y"))))


@query(f"with h as (select vec_id as id, {_HIDDEN_SQL} from embeddings) select id, {_OUT_SQL} from h")
def projection_apply(spark, sf_dir):
    """A map's layers, saved and loaded, applied to all vectors in batches."""
    path = f"{shared_dir(spark)}/lodestar/projection-{uuid.uuid4().hex}"
    semmap.Projection(_layers()).save(spark, path)
    at = semmap.Projection.load(spark, path).transform(table(spark, sf_dir, "embeddings"), id_="vec_id")
    return at.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


EXTEND_SQL = """f as (select lang as source, source as stem, count(*) as rows from documents group by lang, source),
 fo as (select source, stem, rows, row_number() over (partition by source order by stem) as k from f where stem < 'src13'),
 po as (select source, stem, rows, k, cast(0 as bigint) as chunk_id, rows as used from fo where k = 1 union all
 select n.source, n.stem, n.rows, n.k, case when p.used + n.rows <= 60 then p.chunk_id else p.chunk_id + 1 end, case when p.used + n.rows <= 60 then p.used + n.rows else n.rows end from po p join fo n on n.source = p.source and n.k = p.k + 1),
 ch as (select source, chunk_id, sum(rows) as rows from po group by source, chunk_id), la as (select source, max(chunk_id) as last, max_by(rows, chunk_id) as used, sum(rows) as al from ch group by source),
 fn as (select source, stem, rows, row_number() over (partition by source order by stem) as k, sum(rows) over (partition by source) as coming, sum(rows) over (partition by source order by stem) as upto from f where stem >= 'src13' and (stem < 'src15' or source <> 'en')),
 pn as (select source, stem, rows, k, cast(0 as bigint) as c, rows as used from fn where k = 1 union all
 select n.source, n.stem, n.rows, n.k, case when p.used + n.rows <= {cap} then p.c else p.c + 1 end, case when p.used + n.rows <= {cap} then p.used + n.rows else n.rows end from pn p join fn n on n.source = p.source and n.k = p.k + 1)"""


def _extend_sql(cap: int) -> str:
    return f"""select {cap} as capacity, source, stem, rows, chunk_id, global_start, global_end from (with recursive {EXTEND_SQL.format(cap=cap)}
 select pn.source, pn.stem, pn.rows, cast(case when la.last is not null and coming + la.used <= {cap} then la.last else coalesce(la.last + 1, 0) + c end as bigint) as chunk_id, cast(coalesce(al, 0) + upto - pn.rows as bigint) as global_start, cast(coalesce(al, 0) + upto - 1 as bigint) as global_end
 from pn join fn on fn.source = pn.source and fn.stem = pn.stem left join la on la.source = pn.source)"""


@query(" union all ".join(map(_extend_sql, (60, 1000))))
def index_extend(spark, sf_dir):
    """Chunks of new files after an append: in the last chunk if they fit, in new ones otherwise; for two capacities."""
    f = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source"), F.col("source").alias("stem")).agg(F.count(F.lit(1)).alias("rows"))
    chunks = index.packed(f.filter("stem < 'src13'"), 60).groupBy("source", "chunk_id").agg(F.sum("rows").alias("rows"))
    new = f.filter("stem >= 'src13' and (stem < 'src15' or source <> 'en')")
    parts = [update.extended(chunks, new, cap).select(F.lit(cap).alias("capacity"), "source", "stem", "rows", "chunk_id", "global_start", "global_end") for cap in (60, 1000)]
    return parts[0].unionByName(parts[1])


@query(
    """with e as (select user_id % 7 as source, user_id as stem, ts from events), c as (select source, stem, epoch_us(max(ts)) / 1e6 as mtime from e where ts >= timestamp '2024-01-10' group by all), r as (select stem, epoch_us(max(ts)) / 1e6 as mtime from e where ts < timestamp '2024-01-30' and source <> 5 group by stem),
 d as (select c.source, case when r.stem is null then 'new' when c.mtime > r.mtime + 1.0 and c.source not in (0, 1, 2) then 'modified' else 'same' end as change from c left join r using (stem) where c.source <> 2 or r.stem is not null)
 select source, case when source = 1 or count(*) filter (where change = 'modified') > 0 then 'full' when count(*) filter (where change = 'new') > 0 then 'incremental' else 'none' end as todo from d group by source"""
)
def update_decisions(spark, sf_dir):
    """What an update has to do for each source."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("source"), F.col("user_id").alias("stem"), "ts")
    last = lambda df: df.groupBy("source", "stem").agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6).alias("mtime"))
    now, then = last(e.filter("ts >= timestamp'2024-01-10'")), last(e.filter("ts < timestamp'2024-01-30' and source <> 5")).drop("source")
    changes = index.changed(now, then).join(now.select("stem", "source"), "stem")
    changes = changes.withColumn("change", F.when((F.col("change") == "modified") & F.col("source").isin(0, 1, 2), "same").otherwise(F.col("change"))).filter("source <> 2 or change <> 'new'")
    widths = spark.range(7).select(F.col("id").alias("source"), F.lit(48).alias("recorded"), F.when(F.col("id") == 1, 40).otherwise(48).alias("current"))
    return update.decisions(changes, widths)


@query(
    """with s as (select o_orderpriority as source, case when o_orderkey % 5 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as d from orders where o_orderpriority <> '5-LOW'), w as (select source, coalesce(max(try_cast(d as date)) filter (where d <> 'soon' and d < '1996-06-01'), date '1990-01-01') as since from s group by source),
 b as (select o_orderpriority as source, date_trunc('month', o_orderdate) as m, count(*) as n from orders where o_orderpriority <> '5-LOW' group by all),
 u as (select source, coalesce(min(m) filter (where n % 13 = 0), max(m + interval 1 month - interval 1 day)) as until from b group by source)
 select source, since, cast(until as date) as until from w join u using (source)"""
)
def fetch_watermark(spark, sf_dir):
    """Since when a source is fetched, and how far its clock moves: to the first month that failed."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").withColumn("source", F.col("o_orderpriority"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    states = o.select("source", F.when(F.col("o_orderkey") % 5 == 0, "soon").when(day < "1996-06-01", day).otherwise(F.lit(None)).alias("last_fetch_date"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    blocks = o.groupBy("source", month.alias("block_start")).agg((F.count(F.lit(1)) % 13 != 0).alias("ok")).withColumn("block_end", F.last_day("block_start"))
    return update.watermarks(states).join(update.advanced(blocks), "source")


@query("select coalesce(strftime(max(try_cast(d as date)), '%Y-%m-%d'), 'N/A') as last_update from (select case when o_orderkey % 3 = 0 then 'never' else strftime(o_orderdate, '%Y-%m-%d') end as d from orders) union all select 'N/A'")
def last_update(spark, sf_dir):
    states = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_fetch_date"))
    return update.last_update(states).unionByName(update.last_update(states.filter("last_fetch_date = 'never'")))


CHECKED_SQL = """e as (select label as stem, vec_id as local_idx, 1.0 - (case when label = 3 then 8 when vec_id % 2 = 1 then 1 else 0 end) / 64.0 as sim, row_number() over (partition by label order by md5(label || '-' || vec_id), vec_id) as k, count(*) over (partition by label) as n from embeddings),
 c as (select stem, max(n) as rows, max(n) + case when stem = 4 then 1 else 0 end as expected, count(*) filter (where k <= 5) as sampled, round(avg(sim) filter (where k <= 5), 9) as avg_sim, min(sim) filter (where k <= 5) as min_sim, max(sim) filter (where k <= 5) as max_sim from e group by stem),
 r as (select *, rows = expected and min_sim >= 0.96 as ok from c union all select 77, 0, 9, 0, null, null, null, false)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each chunk against fresh ones: one chunk's differ, one's rows are too few, one has none."""
    c = stored(spark, sf_dir).select(F.col("chunk_id").cast("long").alias("stem"), F.col("id").alias("local_idx"), "c0")
    other = F.when(F.col("stem") == 3, F.lit(255)).when(F.col("local_idx") % 2 == 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
    expected = c.groupBy("stem").agg((F.count(F.lit(1)) + F.when(F.col("stem") == 4, 1).otherwise(0)).alias("rows"))
    expected = expected.unionByName(spark.range(1).select(F.lit(77).cast("long").alias("stem"), F.lit(9).cast("long").alias("rows")))
    fresh = update.sampled_rows(c).withColumn("c0", F.col("c0").bitwiseXOR(other))
    return update.checked(c, fresh, expected).withColumn("avg_sim", F.round("avg_sim", 9))


@query(f"with {CHECKED_SQL} select * from r")
def integrity_by_file(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(f"with {CHECKED_SQL} select count(*) as files, count(*) filter (where ok) as passed, round(avg(cast(ok as integer)), 9) as pass_rate, round(avg(avg_sim) filter (where ok), 8) as avg_sim, min(min_sim) filter (where ok) as min_sim, max(max_sim) filter (where ok) as max_sim from r")
def spot_check_report(spark, sf_dir):
    return update.spot_report(_checked(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 9)).withColumn("avg_sim", F.round("avg_sim", 8))


@query(f"with {CHECKED_SQL} select stem from r where not ok")
def stale_codes(spark, sf_dir):
    """Files whose codes have to be made again."""
    return update.stale(_checked(spark, sf_dir))


@query(f"with {POINTS_SQL} select source, xi, yi, count(*) as n from ce group by all")
def grid_table(spark, sf_dir):
    """A grid written as a table and read back."""
    path = f"{shared_dir(spark)}/lodestar/grid-{uuid.uuid4().hex}"
    catalog.write_grid(_cells(spark, sf_dir).groupBy("source", "xi", "yi").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("source int, xi int, yi int, n long").parquet(path)
