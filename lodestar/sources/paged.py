"""A reader of paged records as a data source: blocks of days, each read page by page with a cursor until a page is empty.

Each block is a partition, so blocks are read side by side by tasks. A block's records come with one closing row that says whether it was read to its end; of a block that failed nothing but that row comes, so a clock that moves by closing rows (``update.advanced``)
never passes it. As a stream, offsets are days: a batch takes the blocks up to the first that isn't there yet; a torn one fails its batch, which is read again when the stream starts anew, so it isn't passed either.

Pages come from a client, a function ``(options, block name, cursor) -> list of records or None`` named by the option ``client`` as ``module:function``; None is an empty page. ``folder_page`` is the offline one: a folder of pages
``block=<name>/cursor=<n>/`` with JSON Lines files, on any file system that Arrow opens.
A torn page (one that isn't JSON) fails its block. Records are passed on as JSON text, whatever is in them; a block without pages has its closing row alone.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "block_start date, block_end date, position long, record string, ok boolean"
_ARROW = pa.schema([("block_start", pa.date32()), ("block_end", pa.date32()), ("position", pa.int64()), ("record", pa.string()), ("ok", pa.bool_())])


@dataclass(frozen=True)
class Block(InputPartition):
    start: date
    end: date

    @property
    def name(self) -> str:
        return f"{self.start:%Y%m%d}_{self.end:%Y%m%d}"


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def blocks(start: date, end: date, days: int = 0) -> list[Block]:
    """Blocks of ``days`` days, or of months that begin on the first, from start to end (both count)."""
    out = []
    while start <= end:
        after = start + timedelta(days=days) if days else _next_month(start)
        out.append(Block(start, min(end, after - timedelta(days=1))))
        start = after
    return out


def folder_page(options: dict, block: str, cursor: int) -> list[dict] | None:
    """A page of the offline form; a missing folder is an empty page."""
    system, root = fs.FileSystem.from_uri(options["path"]) if ":/" in options["path"] else (fs.LocalFileSystem(), options["path"])
    found = system.get_file_info(fs.FileSelector(f"{root}/block={block}/cursor={cursor}", allow_not_found=True))
    rows: list[dict] = []
    for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
        with system.open_input_stream(f.path) as stream:
            rows += [json.loads(line) for line in stream.read().decode().splitlines() if line.strip()]
    return rows or None


def has_block(options: dict, block: str) -> bool:
    system, root = fs.FileSystem.from_uri(options["path"]) if ":/" in options["path"] else (fs.LocalFileSystem(), options["path"])
    return system.get_file_info(f"{root}/block={block}").type == fs.FileType.Directory


def _client(options: dict):
    module, _, name = options.get("client", "lodestar.sources.paged:folder_page").partition(":")
    return getattr(importlib.import_module(module), name)


def _records(options: dict, block: Block) -> list[str]:
    page, out, cursor = _client(options), [], 0
    while rows := page(options, block.name, cursor):
        out += [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows]
        cursor += len(rows)
    return out


def _read(options: dict, block: Block) -> Iterator[pa.RecordBatch]:
    """The block's records in batches, then its closing row."""
    try:
        rows, ok = _records(options, block), True
    except (OSError, ValueError):
        rows, ok = [], False
    step = int(options.get("batch", 4096))
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        n = len(some)
        yield pa.RecordBatch.from_pydict({"block_start": [block.start] * n, "block_end": [block.end] * n, "position": list(range(i, i + n)), "record": some, "ok": [True] * n}, schema=_ARROW)
    yield pa.RecordBatch.from_pydict({"block_start": [block.start], "block_end": [block.end], "position": [len(rows)], "record": [None], "ok": [ok]}, schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Block]:
        o = self.options
        return blocks(date.fromisoformat(o["start"]), date.fromisoformat(o["end"]), int(o.get("days", 0)))

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class _Stream(DataSourceStreamReader):
    """Offsets name the first day that isn't read."""

    def __init__(self, options: dict):
        self.options, self.days = options, int(options.get("days", 0))
        self.limit = int(options.get("blocks_per_batch", 12))
        self.at: date | None = None

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def latestOffset(self) -> dict:
        """After the last block that is there: at most ``blocks_per_batch`` from where reading is, and never beyond one that is missing."""
        day = self.at or date.fromisoformat(self.options["start"])
        for block in blocks(day, date.fromisoformat(self.options["end"]), self.days)[: self.limit]:
            if not has_block(self.options, block.name):
                break
            day = block.end + timedelta(days=1)
        self.at = day
        return {"day": day.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        self.at = max(self.at or date.min, date.fromisoformat(end["day"]))
        return blocks(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(days=1), self.days)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        for batch in _read(self.options, partition):
            if not all(batch.column("ok").to_pylist()):
                raise ValueError(f"block {partition.name} can't be read to its end")
            yield batch

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.read.format("paged")`` and ``readStream``: options ``path``, ``start``, ``end``, ``days`` (months if 0), ``client``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def paged(spark: SparkSession, path: str, start: str, end: str, stream: bool = False, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return (spark.readStream if stream else spark.read).format("paged").options(path=path, start=start, end=end, **options).load()


def write_pages(records: DataFrame, path: str, page: int, block: str = "block", order: str = "id") -> None:
    """Records (``block``, an order, and other columns) as a folder of pages of ``page`` records for ``folder_page``. Records of a block are numbered in order; a block is a bounded span of days."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = F.row_number().over(Window.partitionBy(block).orderBy(order)) - 1
    rows = records.withColumn("_n", n).withColumn("cursor", (F.floor(F.col("_n") / page) * page).cast("long"))
    kept = [c for c in records.columns if c != block]
    # A page is one file, so that its records have an order.
    rows.select(F.col(block).alias("block"), "cursor", "_n", F.to_json(F.struct(*kept)).alias("value")).repartition("block", "cursor").sortWithinPartitions("block", "cursor", "_n").drop("_n").write.partitionBy("block", "cursor").text(path)
