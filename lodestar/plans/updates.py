"""Queries that update an index, or ingest, in several runs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.update_run import Index, run_update
from ..session import shared_dir
from ..streaming.known import ingest_known
from ..streaming.live import follow
from .queries import EXTEND_SQL, query, table


@query(
    f"""select source, stem, rows, chunk_id, global_start, global_end, codes, runs from (with recursive {EXTEND_SQL.replace("(stem < 'src15' or source <> 'en')", "true").format(cap=60)},
 old as (select source, stem, rows, chunk_id, cast(sum(rows) over (partition by source order by stem) - rows as bigint) as global_start, cast(sum(rows) over (partition by source order by stem) - 1 as bigint) as global_end from po),
 new as (select pn.source, pn.stem, pn.rows, cast(case when la.last is not null and coming + la.used <= 60 then la.last else coalesce(la.last + 1, 0) + c end as bigint) as chunk_id, cast(coalesce(al, 0) + upto - pn.rows as bigint) as global_start, cast(coalesce(al, 0) + upto - 1 as bigint) as global_end
  from pn join fn on fn.source = pn.source and fn.stem = pn.stem left join la on la.source = pn.source)
 select *, rows as codes, cast(2 as bigint) as runs from (select * from old union all select * from new))"""
)
def update_run(spark, sf_dir):
    """Where the files of all sources lie after three updates: the first sees part of the files, the second all, and the third finds nothing to do and writes nothing."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("source").alias("stem"), "doc_id", "text")
    files = d.groupBy("source", "stem").agg(F.count(F.lit(1)).alias("rows")).withColumn("mtime", F.lit(1000.0))

    def rows(wanted):
        own = d.join(F.broadcast(wanted), ["source", "stem"])  # a row of metadata for each file
        return own.withColumn("local_idx", F.expr("row_number() over (partition by source, stem order by doc_id) - 1")).drop("doc_id")

    root = f"{shared_dir(spark)}/lodestar/index-{uuid.uuid4().hex}"
    for seen in (files.filter("stem < 'src13'"), files, files):
        run_update(spark, root, seen, rows, 60)
    at = Index(spark, root)
    codes = at.codes().groupBy("source", "stem").agg(F.count_distinct("corpus_id").alias("codes"))
    placed = at.files().join(codes, ["source", "stem"]).withColumn("runs", F.lit(at.versions.latest()[0] + 1).cast("long"))
    return placed.select("source", "stem", "rows", "chunk_id", "global_start", "global_end", "codes", "runs")


@query("select min(doc_id) as doc_id, count(distinct text) > 0 as kept, text from documents where text is not null group by text union all select doc_id, true, text from documents where text is null")
def known_keys_ingest(spark, sf_dir):
    """Documents of distinct texts, through a stream over many small files that remembers its keys in a table. Which of equal texts stays depends on when it came, so the smallest id of each is told."""
    root = f"{shared_dir(spark)}/lodestar/known-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d.repartition(8).write.option("maxRecordsPerFile", 1 << 16).parquet(f"{root}/in")
    known = ingest_known(spark, f"{root}/in", d.schema, "text", f"{root}/out", f"{root}/checkpoint", files_per_batch=3)
    stayed = known.rows(d.schema).withColumn("kept", F.lit(True))
    # Texts are joined by their digests, so whole ones are shuffled on one side only.
    name = F.sha2("text", 256).alias("name")
    first = d.filter("text is not null").groupBy(name).agg(F.min("doc_id").alias("least"))
    return stayed.withColumn("name", name).join(first, "name", "left").select(F.coalesce("least", "doc_id").alias("doc_id"), "kept", "text")


@query("with s as (select user_id, epoch_ms(max(ts)) as last_seen from events group by user_id) select count(*) filter (where last_seen >= (select max(last_seen) from s) - 1000 * 7200) as active from s")
def live_sessions(spark, sf_dir):
    """Active sessions at the last tick of a stream of events: the changes that timers and events told, summed up to the newest event."""
    root = f"{shared_dir(spark)}/lodestar/live-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("last_seen"))
    e.write.parquet(f"{root}/in")
    follow(spark, spark.readStream.schema(e.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint", horizon_s=7200)
    now = e.agg(F.timestamp_millis(F.unix_millis(F.max("last_seen"))).alias("now"))
    changes = spark.read.schema("session_id string, at timestamp, change int").parquet(f"{root}/out")
    return changes.join(F.broadcast(now), F.col("at") <= F.col("now")).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("active"))  # one row
