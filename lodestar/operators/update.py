"""Updates of an index as table operations: what to do, where new files go, how far fetching came, which codes are stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hamming, similarity
from .index import placed_files
from .search import limbs

#: Where fetching begins without a state.
EPOCH = "1990-01-01"


def decisions(changes: DataFrame, widths: DataFrame | None = None, source: str = "source") -> DataFrame:
    """``source, todo``: ``full``, ``incremental`` or ``none`` for each source of ``changes`` (``source, change``).

    Modified files, or codes of another width (``widths``: ``source, recorded, current``; no record is another width), ask for all to be made anew.
    """
    got = changes.groupBy(source).agg(F.count_if(F.col("change") == "modified").alias("modified"), F.count_if(F.col("change") == "new").alias("new"))
    wide = F.lit(False)
    if widths is not None:
        other = widths.select(F.col(source).alias("_s"), F.coalesce(F.col("recorded") != F.col("current"), F.lit(True)).alias("_wide"))
        got, wide = got.join(other, F.col(source) == F.col("_s"), "left"), F.coalesce("_wide", F.lit(False))
    return got.select(source, F.when(wide | (F.col("modified") > 0), "full").when(F.col("new") > 0, "incremental").otherwise("none").alias("todo"))


def extended(chunks: DataFrame, files: DataFrame, capacity: int, source: str = "source", stem: str = "stem") -> DataFrame:
    """``files`` (``source, stem, rows``) with ``chunk_id, global_start, global_end`` after ``chunks`` (``source, chunk_id, rows``).

    The new files of a source go to its last chunk if all of them fit there, otherwise into chunks of their own by next fit. Ids go on where they ended.
    """
    last = chunks.groupBy(F.col(source).alias("_s")).agg(F.max("chunk_id").alias("_last"), F.max_by("rows", "chunk_id").alias("_used"), F.sum("rows").alias("_all"))
    coming = files.groupBy(F.col(source).alias("_t")).agg(F.sum("rows").alias("_coming"))
    spots = placed_files(files, capacity, order=stem, source=source)
    placed = files.join(spots, F.col(source).cast("string").eqNullSafe(F.col("_source")) & (F.col(stem).cast("string") == F.col("_o"))).drop("_source", "_o")
    placed = placed.withColumn("global_start", F.col("start")).withColumn("global_end", F.col("start") + F.col("n") - 1)
    both = placed.join(coming, F.col(source) == F.col("_t")).join(last, F.col(source) == F.col("_s"), "left")
    fits = F.col("_last").isNotNull() & (F.col("_coming") + F.col("_used") <= capacity)
    chunk = F.when(fits, F.col("_last")).otherwise(F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("chunk_id"))
    before = F.coalesce("_all", F.lit(0))
    return both.select(source, stem, "rows", chunk.cast("long").alias("chunk_id"), (F.col("global_start") + before).alias("global_start"), (F.col("global_end") + before).alias("global_end"))


def watermarks(states: DataFrame, source: str = "source", date: str = "last_fetch_date", default: str = EPOCH) -> DataFrame:
    """``source, since``: the day from which a source is fetched; a missing or unreadable state counts as ``default``."""
    return states.groupBy(source).agg(F.coalesce(F.max(F.try_to_date(F.col(date), "yyyy-MM-dd")), F.lit(default).cast("date")).alias("since"))


def advanced(blocks: DataFrame, source: str = "source") -> DataFrame:
    """``source, until`` of fetched ``blocks`` (``source, block_start, block_end, ok``): the clock moves to the first block that failed, or to the end."""
    failed = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("block_start")))
    return blocks.groupBy(source).agg(F.coalesce(failed, F.max("block_end")).alias("until"))


def last_update(states: DataFrame, date: str = "last_fetch_date") -> DataFrame:
    """One row ``last_update``: the newest day that can be read, or ``N/A``."""
    return states.agg(F.coalesce(F.date_format(F.max(F.try_to_date(F.col(date), "yyyy-MM-dd")), "yyyy-MM-dd"), F.lit("N/A")).alias("last_update"))


def checked(stored: DataFrame, fresh: DataFrame, expected: DataFrame, least: float = 0.96, samples: int = 5, key: Sequence[str] = ("stem", "local_idx")) -> DataFrame:
    """``stem, rows, expected, sampled, avg_sim, min_sim, max_sim, ok`` for each file of ``expected`` (``stem, rows``).

    A file is in order if it has a code for each row, all of the width of ``fresh``, and its sampled codes are similar enough to fresh ones. The sample is the first rows by hash; pass as ``fresh`` codes of
    ``sampled_rows`` only, so that few texts are encoded again.
    """
    stem, row = key
    columns, wide = limbs(fresh), limbs(stored) == limbs(fresh)
    counts = stored.groupBy(F.col(stem).alias("_stem")).agg(F.count(F.lit(1)).alias("rows"))
    names = [c for c in columns if c in stored.columns]
    other = fresh.select(F.col(stem).alias("_f"), F.col(row).alias("_r"), *(F.col(c).alias(f"_{c}") for c in names))
    sim = similarity(hamming([F.col(c) for c in names], [F.col(f"_{c}") for c in names]), 64 * len(names))
    same = sampled_rows(stored, samples, key).join(other, (F.col(stem) == F.col("_f")) & (F.col(row) == F.col("_r"))).select(F.col(stem).alias("_sampled"), sim.alias("s"))
    sims = same.groupBy("_sampled").agg(F.count(F.lit(1)).alias("sampled"), F.avg("s").alias("avg_sim"), F.min("s").alias("min_sim"), F.max("s").alias("max_sim"))
    all_ = expected.select(F.col(stem).alias("_file"), F.col("rows").alias("expected")).join(counts, F.col("_file") == F.col("_stem"), "left").join(sims, F.col("_file") == F.col("_sampled"), "left")
    ok = F.lit(wide) & (F.coalesce("rows", F.lit(0)) == F.col("expected")) & ((F.col("expected") == 0) | (F.coalesce("min_sim", F.lit(0.0)) >= least))
    return all_.select(F.col("_file").alias(stem), F.coalesce("rows", F.lit(0)).alias("rows"), "expected", F.coalesce("sampled", F.lit(0)).alias("sampled"), "avg_sim", "min_sim", "max_sim", F.coalesce(ok, F.lit(False)).alias("ok"))


def sampled_rows(rows: DataFrame, samples: int = 5, key: Sequence[str] = ("stem", "local_idx")) -> DataFrame:
    """Up to ``samples`` rows of each file, the first by a hash of file and row."""
    stem, row = key
    by = F.md5(F.concat_ws("-", F.col(stem).cast("string"), F.col(row).cast("string")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(stem).orderBy(by, row))).filter(F.col("_n") <= samples).drop("_n")


def spot_report(report: DataFrame) -> DataFrame:
    """One row of what ``checked`` told: files, those that passed and their share, and the similarities of these."""
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return report.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("passed"), (F.count_if("ok") / F.count(F.lit(1))).alias("pass_rate"),
        F.avg(good("avg_sim")).alias("avg_sim"), F.min(good("min_sim")).alias("min_sim"), F.max(good("max_sim")).alias("max_sim"),
    )


def stale(report: DataFrame, force: bool = False) -> DataFrame:
    """``stem`` of the files whose codes have to be made again: those that didn't pass, or all."""
    return (report if force else report.filter(~F.col("ok"))).select("stem")
