"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is a share of all words by its weight, bounded by a multiple of the source's own words; what the bound cuts off
is shared again by weight. A document is taken a whole number of times for sure, and once more with a fractional
probability. The flight moves these probabilities, three documents at a time, through the null space of the two balancing totals of a source, documents and words,
until each is 0 or 1. It runs in cells of a source with a bounded number of rows, so a source that holds a third of all
rows is many cells; a dozen documents of a cell, spread over its sizes, stay behind and meet with the two or fewer that the flight leaves undecided
in the cells of a next round. In the last round these land by the choice that misses the words by least.

Random numbers depend on source, round and cell only: reruns agree. Null and empty texts have size 0. A null source is a source of its own, last in order.
Repeated rows and null ids are rows like any other. An empty table has no rows. Texts of any length count by one expression; other columns are carried whatever they are called.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, text_key, written

WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, as a multiple of all words.
SHARE = 1.5
#: A target's bound, as a multiple of the source's words.
BOUND = 2.0
#: Rows of a cell.
CELL_ROWS = 20_000
#: Rows that land by choice among all combinations.
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"

ROW = "doc_id long, key binary, source string, size long, chance double, base int"
EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, bound: float = BOUND) -> DataFrame:
    """``source, rows, source_size, target`` of a table ``source, size``. Weights repeat in the order of the sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source, summed already
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    totals = written(totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * bound), "sources")
    whole = totals.agg(F.sum("source_size")).first()[0] or 0
    rate, before = 0.0, -1.0
    while rate > before:  # more sources reach their bound each time, or none does
        cut = F.col("most") <= F.col("weight") * rate
        got = totals.agg(F.coalesce(F.sum(F.when(cut, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0.0))).first()
        before = rate
        rate = max(rate, (share * whole - got[0]) / got[1]) if got[1] else rate
    return totals.select("source", "rows", "source_size", F.least("most", F.col("weight") * rate).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the chances to 0 or 1 with their sum and their sum of sizes kept; all but two at most get there."""
    p, s = chance.tolist(), size.tolist()
    draws = iter(rng.random(len(p) + 8).tolist())
    live: list[int] = []
    for i in itertools.chain(range(len(p)), itertools.repeat(-1)):
        if i >= 0 and EPS < p[i] < 1 - EPS:
            live.append(i)
        while len(live) == 3 or len(live) == 2 and s[live[0]] == s[live[1]]:
            if len(live) == 2 or s[live[0]] == s[live[1]]:
                move = [1, -1]
            else:
                a, b, c = (s[j] for j in live)
                move = [b - c, c - a, a - b]
            up = min((1 - p[j]) / m if m > 0 else p[j] / -m for j, m in zip(live, move, strict=False) if m)
            down = min(p[j] / m if m > 0 else (1 - p[j]) / -m for j, m in zip(live, move, strict=False) if m)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for j, m in zip(live, move, strict=False):
                p[j] = min(1.0, max(0.0, p[j] + step * m))
                p[j] = 0.0 if p[j] < EPS else 1.0 if p[j] > 1 - EPS else p[j]
            live = [j for j in live if 0 < p[j] < 1]
        if i < 0:
            return np.array(p)
    raise AssertionError


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few chances left: of all choices the one that misses the words, and by a tenth of a word each the documents, by least."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    out = chance.copy()
    if len(left):
        p, s = chance[left], size[left]
        choices = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        miss = np.abs(choices @ s - p @ s) + 0.1 * np.abs(choices.sum(axis=1) - p.sum())
        out[left] = choices[np.argmin(miss.round(6))]
    return out


def settled(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Flight of all but a few rows spread over the sizes; in the last round these land with the two that the flight leaves."""
    kept = np.unique(np.linspace(0, len(chance) - 1, min(len(chance), LANDING)).astype(int))
    flown = np.setdiff1d(np.arange(len(chance)), kept)
    out = chance.copy()
    out[flown] = flight(chance[flown], size[flown], rng)
    return landing(out, size) if last else out


def _cell(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("dealt", "ascending"), ("doc_id", "ascending"), ("key", "ascending")])
    source, turn, cell, last = (table.column(c)[0].as_py() for c in ("source", "round", "cell", "last"))
    rng = np.random.default_rng(zlib.crc32(repr((source, turn, cell)).encode()))
    chance = settled(table.column("chance").to_numpy(), table.column("size").to_numpy(), rng, last)
    return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance)).select(["doc_id", "key", "source", "size", "chance", "base"])


def _dealt_out(docs: DataFrame, weights: Sequence[float], share: float, bound: float, text: str, source: str, doc_id: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, source, size, copies`` for every row, and the targets; ``key`` names the text."""
    if cell_rows < 2 * (LANDING + 2):
        raise ValueError(f"a cell has {2 * (LANDING + 2)} rows at least, as up to {LANDING + 2} stay behind")
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    goal = written(targets(rows, weights, share, bound), "targets")
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + EPS).cast("int")
    # Sources are few beside rows; the merge join splits a source with very many rows.
    now = rows.alias("r").join(goal.alias("g"), same).select("doc_id", "key", F.col("r.source").alias("source"), "size", F.greatest(F.lit(0.0), rate - base).alias("chance"), base.alias("base"))
    done: list[DataFrame] = []
    for turn in itertools.count():
        open_ = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
        done.append(now.filter(~open_))
        now = now.filter(open_)
        counts = now.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        cells = F.ceil(F.col("n") / cell_rows).cast("int")
        most = counts.agg(F.max("n")).first()[0]
        if not most:
            break
        dealt = now.alias("r").join(counts.select("source", cells.alias("cells")).alias("g"), same)
        dealt = dealt.select("doc_id", "key", F.col("r.source").alias("source"), "size", "chance", "base", "cells", F.xxhash64("doc_id", "key", F.lit(turn)).alias("dealt"))
        dealt = dealt.withColumn("cell", F.pmod("dealt", "cells").cast("int")).withColumn("last", F.col("cells") == 1).withColumn("round", F.lit(turn)).drop("cells")
        now = written(dealt.groupBy("source", "cell").applyInArrow(_cell, ROW), f"round-{turn}")
    taken = done[0]
    for part in done[1:]:
        taken = taken.unionByName(part)
    copies = (F.col("base") + (F.col("chance") > 0.5).cast("int")).cast("int")
    return taken.select("doc_id", "key", "source", "size", copies.alias("copies")), goal


def mixing(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, bound: float = BOUND, text: str = "text", source: str = "source", doc_id: str = "doc_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``; ``taken`` is ``copies * size``."""
    taken, goal = _dealt_out(docs, weights, share, bound, text, source, doc_id, cell_rows)
    out = taken.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    return out.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, bound: float = BOUND, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text, source``), each as often as the mix takes it.

    Texts are shuffled once. Rows of one id, text and source can't be told apart; they are numbered, and the first ones get the further copy.
    """
    taken, _ = _dealt_out(docs, weights, share, bound, "text", "source", "doc_id", cell_rows)
    # Within a source a row is taken `low` times or once more, so a group of like rows is two numbers.
    like = taken.groupBy("doc_id", "key", "source").agg(F.count(F.lit(1)).alias("rows"), F.min("copies").alias("low"), F.sum("copies").alias("all"))
    like = like.filter("all > 0").select(F.col("doc_id").alias("mix_id"), F.col("key").alias("mix_key"), F.col("source").alias("mix_source"), "rows", "low", (F.col("all") - F.col("low") * F.col("rows")).alias("more"))
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("source").cast("string").alias("source"))
    both = named.join(like, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("key") == F.col("mix_key")) & F.col("source").eqNullSafe(F.col("mix_source")))
    alone = both.filter("rows = 1").select("row", (F.col("low") + F.col("more")).alias("copies"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "key", "source").orderBy(F.to_json("row")))
    again = both.filter("rows > 1").withColumn("nth", nth).select("row", (F.col("low") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))
    out = alone.unionByName(again).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
