"""Incremental ingest and the bookkeeping of an index: anti-joins, manifests, packing, offsets, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature
from ..functions.vectors import hamming, similarity
from ..sources.tables import Scratch
from .search import limbs


def new_rows(incoming: DataFrame, existing: DataFrame, key: str | Column, existing_key: str | Column | None = None, within_batch: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key isn't known yet. ``within_batch`` keeps one row of a key that the batch itself repeats. Null keys are new."""
    mine = F.col(key) if isinstance(key, str) else key
    theirs = existing_key if existing_key is not None else key
    known = existing.select((F.col(theirs) if isinstance(theirs, str) else theirs).alias("_known")).distinct()
    out = incoming.withColumn("_key", mine)
    out = out.join(known, F.col("_key") == F.col("_known"), "left_anti")
    if within_batch:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*(order or ("_key",))))).filter(F.col("_key").isNull() | (F.col("_n") == 1)).drop("_n")
    return out.drop("_key")


def digest(*columns: Column) -> Column:
    """32 bytes that stand for the columns' texts; nulls differ from empty texts."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def new_papers(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Papers whose title and abstract together aren't known; digests are compared, texts aren't moved for the comparison."""
    return new_rows(incoming, existing, digest(signature(F.col("title"), F.col("abstract"))))


def drop_repeats(papers: DataFrame, columns: Sequence[str] = ("doi", "title", "abstract"), file: str = "source_stem", position: str = "pos") -> DataFrame:
    """The first row of each combination in a file, whose rows have distinct positions. Survivors are found by digest, with partial aggregates, so no group of copies meets in a task."""
    first = papers.groupBy(F.col(file).alias("_f"), digest(*map(F.col, columns)).alias("_c")).agg(F.min(position).alias("_p")).select("_f", "_p")
    return papers.join(first, F.col(file).eqNullSafe(F.col("_f")) & (F.col(position) == F.col("_p")), "left_semi")


def latest_revision(papers: DataFrame, key: str = "pmid") -> DataFrame:
    """The newest version of each record across files."""
    order = Window.partitionBy(key).orderBy(F.col("version").cast("int").desc_nulls_last(), F.col("source_stem").desc())
    return papers.withColumn("_n", F.row_number().over(order)).filter(F.col(key).isNull() | (F.col("_n") == 1)).drop("_n")


def pending(files: DataFrame, manifest: DataFrame, stem: str = "stem") -> DataFrame:
    """Files that are neither queued nor being worked on nor done; failed ones come again."""
    return files.join(manifest.filter(F.col("state").isin("pending", "in_progress", "completed")).select(stem), stem, "left_anti")


def paired(files: DataFrame, embedded: DataFrame, stem: str = "stem") -> DataFrame:
    """``stem, paired`` for each file."""
    return files.select(stem).join(embedded.select(stem).distinct().withColumn("_e", F.lit(True)), stem, "left").select(stem, F.coalesce("_e", F.lit(False)).alias("paired"))


def changed(current: DataFrame, recorded: DataFrame, slack: float = 1.0) -> DataFrame:
    """``stem, change``: new files and those modified more than ``slack`` seconds after the record; records without a time count as unchanged, gone files aren't told."""
    both = current.select("stem", "mtime").join(recorded.select("stem", F.col("mtime").alias("_was"), F.lit(True).alias("_known")), "stem", "left")
    change = F.when(F.col("_known").isNull(), "new").when(F.col("mtime") > F.col("_was") + slack, "modified").otherwise("same")
    return both.select("stem", change.alias("change"))


def freshness(changes: DataFrame, width_changed: bool = False) -> str:
    """What an update has to do: ``full``, ``incremental`` or ``none``. Two counts reach the driver."""
    if width_changed:
        return "full"
    got = changes.agg(F.count_if(F.col("change") == "modified").alias("m"), F.count_if(F.col("change") == "new").alias("n")).first()
    return "full" if got.m else "incremental" if got.n else "none"


def offsets(files: DataFrame, rows: str = "rows", order: str = "stem", source: str | None = None) -> DataFrame:
    """``global_start`` and ``global_end`` (inclusive) of each file: a running sum in order, by source if there is one."""
    window = Window.partitionBy(*([source] if source else [])).orderBy(order)
    upto = F.sum(rows).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return files.withColumn("global_start", upto - F.col(rows)).withColumn("global_end", upto - 1)


def numbered(files: DataFrame, scratch: Scratch, rows: str = "rows", order: str = "stem", source: str = "source") -> DataFrame:
    """``_source, _o, n, i, start``: each file's place in the order of its source, and the rows before it. Files are dealt by ranges of the order; sums of ranges are carried over, so no source is one task's work."""
    kept = files.select(F.col(source).cast("string").alias("_source"), F.col(order).cast("string").alias("_o"), F.col(rows).cast("long").alias("n"))
    # Written, as ranges come from a sample and have to stay.
    ranged = scratch.write(kept.repartitionByRange("_source", "_o").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_source", "part").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("_source", "part").orderBy("_o")
    own = ranged.withColumn("k", F.row_number().over(inside) - 1).withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = own.join(F.broadcast(carried), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))  # a row for each source and range
    return scratch.write(both.select("_source", "_o", "n", (F.col("first") + F.col("k")).alias("i"), (F.col("base") + F.col("upto") - F.col("n")).alias("start")), "numbered")


def packed(files: DataFrame, capacity: int, rows: str = "rows", order: str = "stem", source: str = "source") -> DataFrame:
    """``chunk_id`` by next fit in order, for each source: a file that doesn't fit opens a chunk; one larger than a chunk has it alone. Files of a source have distinct names, and rows of 0 or more.

    The chunk that a file opens ends before the file that holds the row ``capacity`` further on, which an equi-join on cells of that many rows finds. From the first file of a source, pointers to the next chunk's first file are doubled until all chunks are reached.
    """
    placed = placed_files(files, capacity, rows, order, source).select("_source", "_o", "chunk_id")
    return files.join(placed, F.col(source).cast("string").eqNullSafe(F.col("_source")) & (F.col(order).cast("string") == F.col("_o"))).drop("_source", "_o")


def placed_files(files: DataFrame, capacity: int, rows: str = "rows", order: str = "stem", source: str = "source") -> DataFrame:
    """``_source, _o, n, start, chunk_id``, by the rule of :func:`packed`."""
    scratch = Scratch(files.sparkSession, "packing")
    each = numbered(files, scratch, rows, order, source)
    cells = each.filter("n > 0").select(F.col("_source").alias("_s"), F.col("i").alias("holder"), F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"), F.explode(F.sequence(F.expr(f"start div {capacity}"), F.expr(f"(start + n - 1) div {capacity}"))).alias("cell"))
    asked = each.select("_source", "i", (F.col("start") + capacity).alias("at")).withColumn("_c", F.expr(f"at div {capacity}"))
    holds = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("cell"))
    step = asked.join(cells, holds).filter((F.col("low") <= F.col("at")) & (F.col("at") < F.col("high"))).select("_source", "i", F.greatest(F.col("i") + 1, "holder").alias("to"))
    first = step = scratch.write(step.withColumn("to", F.col("to").cast("long")), "next")
    starts = each.filter("i = 0").select("_source", F.col("i").cast("long").alias("i"), F.lit(0).cast("long").alias("chunk_id"))
    far = 1
    while True:
        hop = step.select(F.col("_source").alias("_s"), F.col("i").alias("_i"), "to")
        on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_i"))
        reached = starts.join(hop, on).select("_source", F.col("to").alias("i"), (F.col("chunk_id") + far).alias("chunk_id"))
        starts = scratch.write(starts.unionByName(reached), "starts")
        after = step.select(F.col("_source").alias("_s"), F.col("i").alias("_i"), F.col("to").alias("then"))
        step = scratch.write(step.join(after, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("to") == F.col("_i"))).select("_source", "i", F.col("then").alias("to")), f"hops-{far}")
        far *= 2
        if not step.head(1):
            break
    # A chunk has the files from its first to the next chunk's first; the last one has all that are left.
    last = each.groupBy(F.col("_source").alias("_l")).agg((F.max("i") + 1).alias("end"))
    ends = first.select(F.col("_source").alias("_s"), F.col("i").alias("_i"), "to")
    spans = starts.join(ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_i")), "left").join(F.broadcast(last), F.col("_source").eqNullSafe(F.col("_l")))  # a row for each source
    spans = spans.filter(F.col("i") < F.col("end"))  # the last file may be larger than a chunk, and points behind itself
    own = spans.select(F.col("_source").alias("_s"), "chunk_id", F.explode(F.sequence("i", F.coalesce("to", "end") - 1)).alias("_i"))
    out = each.join(own, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("i") == F.col("_i"))).select("_source", "_o", "n", "start", "chunk_id")
    out = scratch.write(out, "placed")
    scratch.keep("placed")
    return out


def intervals(metadata: DataFrame) -> DataFrame:
    """Chunk metadata (``chunks`` of ``parts``) flattened to ``global_start, global_end, source_stem, source_local_start``."""
    parts = metadata.select(F.explode("chunks").alias("c")).select(F.col("c.global_start").alias("base"), F.explode("c.parts").alias("p"))
    start, length = F.col("base") + F.col("p.chunk_local_start"), F.col("p.chunk_local_end") - F.col("p.chunk_local_start")
    return parts.select(start.alias("global_start"), (start + length - 1).alias("global_end"), F.col("p.source_stem").alias("source_stem"), F.col("p.source_local_start").alias("source_local_start"))


def located(ids: DataFrame, spans: DataFrame, id_: str = "corpus_id", grain: int = 4096) -> DataFrame:
    """Ids with the file and row that hold them; ids in no interval go.

    The range join is an equi-join on blocks of ``grain`` ids, which intervals are cut into, with the bounds checked after.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("global_start") / grain), F.floor(F.col("global_end") / grain))))
    joined = ids.withColumn("_cell", F.floor(F.col(id_) / grain)).join(cells, "_cell").filter(F.col(id_).between(F.col("global_start"), F.col("global_end")))
    return joined.withColumn("local_idx", F.col(id_) - F.col("global_start") + F.col("source_local_start")).drop("_cell", "global_start", "global_end", "source_local_start")


def integrity(stored: DataFrame, fresh: DataFrame, least: float, key: Sequence[str] = ("id",)) -> DataFrame:
    """One row: pairs compared, mean, least and greatest similarity of stored and fresh codes, and whether all reach ``least``."""
    columns = limbs(stored)
    other = fresh.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    sim = similarity(hamming([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns]), 64 * len(columns))
    both = stored.join(other, list(key)).select(sim.alias("s"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("avg_sim"), F.min("s").alias("min_sim"), F.max("s").alias("max_sim"), F.coalesce(F.min("s") >= least, F.lit(False)).alias("ok"))


def health(files: DataFrame, embedded: DataFrame) -> DataFrame:
    return paired(files, embedded).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("paired")).alias("paired"), F.count_if(~F.col("paired")).alias("missing"))


def totals(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows by source, and of all as source ``all``."""
    counted = rows.rollup(source).agg(F.count(F.lit(1)).alias("n"), F.grouping(source).alias("_all"))
    return counted.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(source)).alias(source), "n")


def active_users(sessions: DataFrame, now: Column, horizon_s: int = 300) -> DataFrame:
    """One row ``active``: sessions last seen within the horizon."""
    last = sessions.groupBy("session_id").agg(F.max("last_seen").alias("last_seen"))
    return last.agg(F.count_if(F.col("last_seen") >= now - horizon_s).alias("active"))


def queue_states(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
