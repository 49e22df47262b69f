"""An update of an index over all its sources, in one run and one commit.

A run compares the files that are there with those of the newest version and decides for each source (``update.decisions``): nothing, new files only, or all anew where a file was modified or codes have another width.
New files are placed after the chunks that are there (``update.extended``), and only the rows of files that need it are encoded. Codes and the table of files are written under the run's own name; the commit of a version that names them is what makes them count.
A run that ends before has changed nothing: it is repeated as it is. A run that finds nothing to do writes nothing.

Files that are gone keep their codes, as ids must not move. Files are told apart by source and stem; a row of ``files`` per file. A file of no rows has its place and no codes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from . import index, update
from .encode import encoded
from .search import limbs

FILES = "source string, stem string, mtime double, rows long, chunk_id long, global_start long, global_end long"
#: Rows of a file, and what is encoded of them: the sources and stems asked for, as ``source, stem, local_idx, text``.
Rows = Callable[[DataFrame], DataFrame]


class Index:
    """The tables of an index under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    @property
    def root(self) -> str:
        return self.versions.root

    def files(self, content: dict | None = None) -> DataFrame:
        content = self.versions.latest()[1] if content is None else content
        if "files" not in content:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/files/{content['files']}")

    def codes(self) -> DataFrame | None:
        """``stem, corpus_id, chunk_id``, limbs and ``source`` of all rows; None before the first version with rows. A source's rows come from the runs that the version names for it."""
        _, content = self.versions.latest()
        by_run: dict[str, list[str]] = {}
        for source, runs in sorted(content.get("codes", {}).items()):
            for run in runs:
                by_run.setdefault(run, []).append(source)
        out: DataFrame | None = None
        for run, sources in by_run.items():
            part = self.run_codes(run, content["width"]).filter(F.col("source").isin(sources))
            out = part if out is None else out.unionByName(part)
        return out

    def run_codes(self, run: str, width: int) -> DataFrame:
        schema = ", ".join(["stem string, corpus_id long, chunk_id long", *(f"c{i} long" for i in range(width)), "source string"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/codes/{run}")

    def chunks(self) -> DataFrame:
        """``source, chunk_id, rows, global_start, global_end``."""
        return self.files().groupBy("source", "chunk_id").agg(F.sum("rows").alias("rows"), F.min("global_start").alias("global_start"), F.max("global_end").alias("global_end"))

    def clean(self) -> list[str]:
        """Deletes what runs that weren't committed, or versions before the newest, have left."""
        _, content = self.versions.latest()
        runs = {run for runs in content.get("codes", {}).values() for run in runs}
        return self.versions.clean("codes", runs) + self.versions.clean("files", {content.get("files", "")})


def run_update(spark: SparkSession, root: str, files: DataFrame, rows: Rows, capacity: int, text: str = "text", slack: float = 1.0, width: int = 1, encoder=None) -> dict[str, str]:
    """What was done for each source: ``full``, ``incremental`` or ``none``. ``files``: ``source, stem, mtime, rows``; ``rows`` gives the rows of those asked for; codes have ``width`` limbs."""
    at = Index(spark, root)
    base, content = at.versions.latest()
    known = at.files(content)
    key = F.struct("source", "stem")
    present = files.select(F.col("source").cast("string").alias("source"), F.col("stem").cast("string").alias("stem"), F.col("mtime").cast("double").alias("mtime"), F.col("rows").cast("long").alias("rows"))
    changes = index.changed(present.select(key.alias("stem"), "mtime"), known.select(key.alias("stem"), "mtime"), slack).select("stem.source", F.col("stem.stem").alias("stem"), "change")
    todo = {r.source: r.todo for r in update.decisions(changes).collect()}  # a row for each source
    if content and content.get("width") != width:
        todo = dict.fromkeys(todo, "full")
    full, more = ([s for s, t in sorted(todo.items()) if t == kind] for kind in ("full", "incremental"))
    if not full and not more:
        return todo
    run = uuid.uuid4().hex
    fresh = changes.filter(F.col("source").isin(full) | (F.col("source").isin(more) & (F.col("change") == "new"))).select("source", "stem")
    coming = present.join(fresh, ["source", "stem"], "left_semi")
    chunks = known.filter(F.col("source").isin(more)).groupBy("source", "chunk_id").agg(F.sum("rows").alias("rows"))
    placed = update.extended(chunks, coming.drop("mtime"), capacity).join(coming.select("source", "stem", "mtime"), ["source", "stem"])
    names = [c.split(" ")[0] for c in FILES.split(", ")]
    placed = placed.select(*(F.col(c) for c in names))
    kept = known.filter(~F.col("source").isin(full)).select(*names)
    kept.unionByName(placed).coalesce(1).write.parquet(f"{at.root}/files/{run}")
    # Read back, so that the ids of the codes are those that were written.
    new = spark.read.schema(FILES).parquet(f"{at.root}/files/{run}").join(fresh, ["source", "stem"], "left_semi")
    texts = rows(fresh).join(F.broadcast(new.select("source", "stem", "chunk_id", "global_start")), ["source", "stem"])  # a row of metadata for each file
    made = encoded(texts, F.col(text), **({"encoder": encoder} if encoder else {}), limbs=width)
    out = made.select("source", "stem", (F.col("global_start") + F.col("local_idx")).alias("corpus_id"), "chunk_id", *limbs(made))
    out.repartition("source", "chunk_id").sortWithinPartitions("source", "corpus_id").write.partitionBy("source").parquet(f"{at.root}/codes/{run}")
    written = [r.source for r in at.run_codes(run, width).select("source").distinct().collect()]  # a row for each source
    before = content.get("codes", {})
    codes = {s: ([] if s in full else before.get(s, [])) + [run] * (s in written) for s in {*before, *written}}
    at.versions.commit(base, {"files": run, "codes": {s: runs for s, runs in codes.items() if runs}, "width": width})
    return todo
