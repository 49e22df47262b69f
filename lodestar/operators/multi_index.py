"""Exact nearest codes by multi-index hashing, from a stored index and below a full scan.

Codes are cut into parts of about log2(rows) bits, and a table holds each code once for each part, under the part's value. Two codes that differ in r bits differ in at most r / parts bits of one of the parts.
So all codes that differ in fewer than ``parts * (radius + 1)`` bits are found under the values that differ in up to ``radius`` bits from the query's own. A search goes on radius by radius, each with the queries whose k nearest aren't certain yet.

The table is dealt into folders by part and leading bits of the value and sorted by value, so a reading takes the folders that a query can be in, and in a file the row groups. Where the values to look up outgrow the table,
the queries that are left take one reading of all codes (``search.knn``), which is then less work.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import Scratch
from .search import knn, limbs

#: Leading bits of a value by which a part has folders; rows of values to look up that are sent to all tasks.
LEAD, SENT = 5, 1 << 18


@dataclass(frozen=True)
class MultiIndex:
    """What is known of a stored index: its folder, rows, limbs of a code, and where its parts begin."""

    path: str
    rows: int
    limbs: int
    begins: tuple[int, ...]

    @property
    def widths(self) -> tuple[int, ...]:
        ends = (*self.begins[1:], 64 * self.limbs)
        return tuple(b - a for a, b in zip(self.begins, ends, strict=True))

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(self.limbs)]

    def value(self, part: int) -> Column:
        """The bits of a part, lowest first."""
        begin, width = self.begins[part], self.widths[part]
        limb, shift = divmod(begin, 64)
        low = F.shiftrightunsigned(f"c{limb}", shift)
        if shift + width > 64:
            low = low.bitwiseOR(F.call_function("shiftleft", F.col(f"c{limb + 1}"), F.lit(64 - shift)))
        return low.bitwiseAND(F.lit((1 << width) - 1)).cast("long")

    def lead(self, part: Column, value: Column) -> Column:
        """The folder's leading bits."""
        down = F.element_at(F.array(*(F.lit(max(0, w - LEAD)) for w in self.widths)), part + 1)
        return F.call_function("shiftright", value, down).cast("int")

    @classmethod
    def build(cls, codes: DataFrame, path: str) -> MultiIndex:
        """Writes the table of ``codes`` (``id`` and limbs) once; rows without a code aren't in it."""
        spark, columns = codes.sparkSession, limbs(codes)
        real = codes.filter(F.col(columns[0]).isNotNull()).select("id", *columns)
        rows, bits = real.count(), 64 * len(columns)
        parts = max(1, math.ceil(bits / min(30, max(8, math.ceil(math.log2(max(2, rows)))))))
        out = cls(path, rows, len(columns), tuple(bits * i // parts for i in range(parts)))
        dealt = real.select("id", *columns, F.posexplode(F.array(*(out.value(p) for p in range(parts)))).alias("part", "value"))
        dealt = dealt.withColumn("lead", out.lead(F.col("part"), F.col("value")))
        dealt.repartition("part", "lead").sortWithinPartitions("part", "lead", "value").write.partitionBy("part", "lead").option("compression", "zstd").parquet(f"{path}/codes")
        about = {k: v for k, v in asdict(out).items() if k != "path"}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MultiIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(path, about["rows"], about["limbs"], tuple(about["begins"]))

    def table(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join(["id long", *(f"{c} long" for c in self.columns), "value long", "part int", "lead int"])
        return spark.read.schema(schema).parquet(f"{self.path}/codes")

    def all_codes(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).filter("part = 0").select("id", *self.columns)

    def lookups(self, queries: DataFrame, radius: int) -> DataFrame:
        """``query_id, q0.., part, value, lead``: the values that differ from the query's own in exactly ``radius`` bits of a part."""
        spark = queries.sparkSession
        own = queries.select("query_id", *(f"q{i}" for i in range(self.limbs)), F.posexplode(F.array(*(self.value(p) for p in range(len(self.begins))))).alias("part", "own"))
        flips = [(p, sum(1 << b for b in bits)) for p, w in enumerate(self.widths) for bits in combinations(range(w), radius)]
        masks = spark.createDataFrame(flips, "part int, mask long")
        near = own.join(F.broadcast(masks), "part").withColumn("value", F.col("own").bitwiseXOR(F.col("mask")))
        return near.withColumn("lead", self.lead(F.col("part"), F.col("value"))).drop("own", "mask")

    def read(self, spark: SparkSession, lookups: DataFrame) -> DataFrame:
        """The folders that the values can be in: at most ``2 ** LEAD`` of each part."""
        folders = lookups.select("part", "lead").distinct().collect()
        by_part: dict[int, list[int]] = {}
        for r in folders:
            by_part.setdefault(r.part, []).append(r.lead)
        where = F.lit(False)
        for part, leads in sorted(by_part.items()):
            where |= (F.col("part") == part) & F.col("lead").isin(sorted(leads))
        return self.table(spark).filter(where)

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, id, dist, rank``: the rows that ``search.knn`` gives for ``queries`` (``id`` and limbs)."""
        spark, scratch = queries.sparkSession, Scratch(queries.sparkSession, "lookups")
        pending = scratch.write(queries.filter(F.col("c0").isNotNull()).select(F.col("id").alias("query_id"), *self.columns, *(F.col(c).alias(f"q{i}") for i, c in enumerate(self.columns))), "pending")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
        found: DataFrame | None = None
        finished: list[DataFrame] = []
        for radius in range(max(self.widths) + 1):
            left = pending.count()
            if not left:
                break
            each = sum(math.comb(w, radius) for w in self.widths)
            if left * each > max(self.rows, 1 << 12) or each > SENT:
                exact = knn(self.all_codes(spark), pending.select(F.col("query_id").alias("id"), *self.columns), k)
                finished.append(exact.select("query_id", "id", F.col("dist").cast("long").alias("dist")))
                break
            lookups = scratch.write(self.lookups(pending, radius), "lookups")
            rows = self.read(spark, lookups).select("id", *self.columns, "part", "value")
            sides = F.broadcast(lookups) if left * each <= SENT else lookups
            dist = V.hamming([F.col(c) for c in self.columns], [F.col(f"q{i}") for i in range(self.limbs)])
            hits = rows.join(sides, ["part", "value"]).select("query_id", "id", dist.cast("long").alias("dist"))
            hits = (hits if found is None else hits.unionByName(found)).distinct()
            best = scratch.write(hits.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "found")
            sure = len(self.begins) * (radius + 1) - 1
            ready = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).filter((F.col("far") <= sure) & (F.col("n") >= min(k, self.rows)))
            ready = scratch.write(ready.select("query_id"), "ready")
            finished.append(Scratch(spark, "nearest").write(best.join(ready, "query_id", "left_semi"), f"radius-{radius}"))
            found = best.join(ready, "query_id", "left_anti")
            pending = scratch.write(pending.join(ready, "query_id", "left_anti"), "pending")
        if not finished:
            return spark.createDataFrame([], "query_id long, id long, dist long, rank int")
        out = finished[0]
        for more in finished[1:]:
            out = out.unionByName(more)
        return out.withColumn("rank", rank)

