"""Hamming search over codes, and what happens to its hits: fetch, filter, dedup, relabel, order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.dates import paper_date
from ..functions.text import stripped
from ..sources.catalog import by_ids

# The names of sources, and the columns of a result in their order.
SOURCES = ("PubMed", "BioRxiv", "MedRxiv", "arXiv")
RESULT = ("doi", "title", "authors", "date", "abstract", "score", "source", "journal")
#: Queries that one reading of the codes serves: 40 bytes each for their codes and ids, and 16 bytes for each neighbour kept.
QUERY_BLOCK = 1 << 16
#: Codes that are compared at once: sessions whose rows are texts have small batches.
GATHER_ROWS = 1 << 14


def limbs(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def scored(codes: DataFrame, query: Sequence[int]) -> DataFrame:
    """``codes`` with ``dist`` and ``score`` against a query's limbs, which are constants of the plan."""
    columns = limbs(codes)
    dist = V.hamming([F.col(c) for c in columns], [F.lit(q).cast("long") for q in query])
    return codes.withColumn("dist", dist).withColumn("score", V.similarity(F.col("dist"), V.LIMB * len(columns)))


def topk(codes: DataFrame, query: Sequence[int], k: int, by: Sequence[str] = ("id",)) -> DataFrame:
    return scored(codes, query).orderBy("dist", *by).limit(k)


def topk_per_chunk(codes: DataFrame, query: Sequence[int], k: int, chunk: Sequence[str] = ("chunk_id",), by: Sequence[str] = ("id",)) -> DataFrame:
    """The ``k`` nearest of each chunk: each task keeps its own ``k`` before rows are shuffled."""
    order = Window.partitionBy(*chunk).orderBy("dist", *by)
    return scored(codes, query).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def raw_limit(top_k: int) -> int:
    """Hits that each chunk of the index yields: fixed values."""
    return max(5000, 100 * top_k)


def _gathered(batches: Iterator[pa.RecordBatch], at_least: int = GATHER_ROWS) -> Iterator[pa.Table]:
    """Batches of any size as tables of about ``at_least`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= at_least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _nearest(ids: np.ndarray, limbs_: np.ndarray, k: int):
    """A task's ``k`` nearest rows of each query. Only queries that a batch has something near for are touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.iinfo(np.int64).max
        dist, near = np.full((len(ids), k), far), np.full((len(ids), k), far)
        for rows in _gathered(batches):
            real = rows.filter(rows.column(1).is_valid()).combine_chunks()
            own = real.column(0).to_numpy()
            code = [real.column(i).to_numpy() for i in range(1, real.num_columns)]
            # A byte holds the distance of three limbs.
            kind = np.uint8 if len(code) <= 3 else np.uint16
            for a in range(0, len(ids) if len(own) else 0, 16):
                apart = np.zeros((len(limbs_[a : a + 16]), len(own)), kind)
                for i, c in enumerate(code):
                    apart += np.bitwise_count((c[None] ^ limbs_[a : a + 16, i, None]).view(np.uint64))
                there = apart <= np.minimum(dist[a : a + 16, -1:], np.iinfo(kind).max).astype(kind)
                for j in np.flatnonzero(there.any(axis=1)).tolist():
                    d, i = np.concatenate([dist[a + j], apart[j][there[j]]]), np.concatenate([near[a + j], own[there[j]]])
                    if len(d) > 4 * k:
                        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        d, i = d[some], i[some]
                    order = np.lexsort((i, d))[:k]
                    dist[a + j], near[a + j] = d[order], i[order]
        real = dist < far
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, real.sum(axis=1)), "id": near[real], "dist": dist[real]})

    return run


def knn(codes: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, dist, rank``: the ``k`` nearest rows of each query, exact, ties by id.

    ``codes`` and ``queries`` have ``id`` and limbs. Queries go out in blocks of a bounded size, each with one reading of the codes; a task keeps ``k`` rows for each, so pairs are never shuffled.
    Pairs are compared by as many tasks as the cluster has cores (codes are small, a table of them may be a file or two), and what is shuffled is tasks x queries x k rows at most.
    """
    columns, found, held = limbs(codes), None, []
    dealt = codes.select("id", *columns).repartition(codes.sparkSession.sparkContext.defaultParallelism)

    def probe(rows: list) -> DataFrame:
        ids, code = np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], np.int64)
        return dealt.mapInArrow(_nearest(ids, code, k), "query_id long, id long, dist long")

    for row in queries.select("id", *columns).filter(F.col(columns[0]).isNotNull()).toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            found = probe(held) if found is None else found.unionByName(probe(held))
            held = []
    if held or found is None:
        last = probe(held) if held else codes.sparkSession.createDataFrame([], "query_id long, id long, dist long")
        found = last if found is None else found.unionByName(last)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _is_day(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def within_dates(df: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Both ends count; without both, nothing is filtered. Rows whose date can't be read go."""
    if not (start and end):
        return df
    return df.filter(paper_date(F.col(date)).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def good_quality(df: DataFrame, abstract: str = "abstract", least: int = 75) -> DataFrame:
    """Papers with an abstract of more than ``least`` characters; where the table has its length, the text isn't read."""
    return df.filter((F.col("abstract_length") if "abstract_length" in df.columns else F.length(abstract)) > least)


def strict_map_rows(df: DataFrame) -> DataFrame:
    return good_quality(df.filter(F.col("title").isNotNull() & (F.col("title") != "")))


def _name(key: Column) -> Column:
    """128 bits for a key, so that texts aren't sorted or compared: two hashes with seeds of their own, as what comes first is the seed of what follows."""
    return F.struct(F.xxhash64(key), F.xxhash64(F.lit(1), key))


def live_dedup(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Greedy dedup in rank order as two windows over hashed keys.

    Of rows with one DOI of more than five characters the first stays; then a row with less than five is dropped
    if an earlier one that stayed has its title. Rows outside either rule get a window of their own, so none is large for lack of a key.
    """
    doi = stripped(F.coalesce(F.col("doi"), F.lit("None")))
    title = F.lower(stripped(F.coalesce(F.col("title"), F.lit("None"))))
    own = F.concat(F.lit("\x00"), F.col(rank).cast("string"))
    keyed = df.withColumn("_d", F.length(doi)).withColumn("_dk", _name(F.when(F.length(doi) > 5, doi).otherwise(own))).withColumn("_tk", _name(F.when(title != "", title).otherwise(own)))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_dk").orderBy(rank))).filter("_n = 1")
    second = first.withColumn("_n", F.row_number().over(Window.partitionBy("_tk").orderBy(rank))).filter("_d >= 5 OR _n = 1")
    return second.drop("_d", "_dk", "_tk", "_n")


def relabelled(source: Column, journal: Column, doi: Column) -> Column:
    """Preprints that came with PubMed get their own source: by journal, then by DOI prefix."""
    mine = F.when((source == "PubMed") & F.lower(journal).contains("biorxiv"), "BioRxiv").when((source == "PubMed") & F.lower(journal).contains("medrxiv"), "MedRxiv").otherwise(source)
    return F.when((mine == "PubMed") & doi.rlike("10.1101"), "BioRxiv").otherwise(mine)


def harmonized(papers: DataFrame, source: str | None = None) -> DataFrame:
    """The columns of a result whatever the file calls them; missing ones are null."""
    by_lower = {c.lower(): c for c in reversed(papers.columns)}
    journal = next((F.col(f"`{by_lower[c]}`") for c in ("server", "journal-ref", "journal", "source_title") if c in by_lower), F.lit(None))
    date = next((F.col(c) for c in ("date", "update_date", "posted") if c in papers.columns), F.lit(None))
    named = {"journal": journal, "date": date} | ({"source": F.lit(source)} if source else {})
    null = F.lit(None)
    return papers.select(*(named.get(c, F.col(c) if c in papers.columns else null).cast("double" if c == "score" else "string").alias(c) for c in RESULT))


def search(codes: DataFrame, papers: DataFrame, query: Sequence[int], top_k: int = 10, start: str | None = None, end: str | None = None, high_quality: bool = False, per_chunk: int | None = None, prefilter: bool = False, by_key: bool = False) -> DataFrame:
    """The whole search: hits of each source's chunks, fetched, filtered, deduplicated in rank order, cut at ``top_k`` and relabelled.

    ``codes`` has ``source, corpus_id, chunk_id`` and limbs; ``papers`` has ``source, corpus_id`` and the result's columns. ``prefilter`` filters before ranking instead of after.
    ``by_key`` fetches the final papers by their ids, which are then known when the plan is made (``catalog.write_papers_by_key`` makes the table for it).
    The order is strict: score, then source, then id.
    """
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    for day in (start, end):
        if day and not (len(day) == 10 and _is_day(day)):
            raise ValueError(f"{day!r} is no day of the form YYYY-MM-DD")

    def kept(df: DataFrame) -> DataFrame:
        df = within_dates(df, start, end)
        return good_quality(df) if high_quality else df

    # Filters and dedup work on identifiers, titles and numbers; whole texts are fetched for the rows that are left.
    narrow = kept(papers).select("source", "corpus_id", "doi", "title")
    if prefilter:
        codes = codes.join(narrow.select("source", "corpus_id"), ["source", "corpus_id"], "left_semi")
    hits = topk_per_chunk(codes, query, per_chunk or raw_limit(top_k), ("source", "chunk_id"), ("corpus_id",)).select("source", "corpus_id", "dist", "score")
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    rows = narrow.join(hits, ["source", "corpus_id"]).select("source", "corpus_id", "doi", "title", "score", F.struct("dist", place.alias("place"), "corpus_id").alias("rank"))
    best = live_dedup(rows).orderBy("rank").limit(top_k).select("source", "corpus_id", "score", "rank")
    if by_key:
        ranked = best.select("source", "corpus_id", "score", F.col("rank.dist").alias("dist"), F.col("rank.place").alias("place")).collect()  # ``top_k`` rows
        best = papers.sparkSession.createDataFrame(ranked, "source string, corpus_id long, score double, dist int, place int").withColumn("rank", F.struct("dist", "place", "corpus_id"))
        papers = by_ids(papers, [(r.source, r.corpus_id) for r in ranked])
    top = papers.drop("score").join(F.broadcast(best), ["source", "corpus_id"]).orderBy("rank")  # 100 rows at most
    return top.select("doi", "title", "authors", "date", "abstract", "score", relabelled(F.col("source"), F.col("journal"), F.col("doi")).alias("source"), "journal", "corpus_id")


def ordered(results: DataFrame, by: str = "relevance", ties: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """Order results by relevance, date (unread dates last) or citations."""
    key = {"relevance": F.col("score").desc_nulls_last(), "date": paper_date(F.col("date")).desc_nulls_last()}.get(by)
    return results.orderBy(F.col("citations").desc_nulls_last() if key is None else key, *ties)


def with_citations(results: DataFrame, citations: DataFrame) -> DataFrame:
    """``citations`` (``doi, n``) looked up; arXiv, empty and unknown DOIs have none."""
    known = citations.groupBy(F.col("doi").alias("_doi")).agg(F.max("n").alias("_n"))
    found = results.join(known, F.col("doi") == F.col("_doi"), "left")
    none = F.col("doi").isNull() | (F.col("doi") == "") | F.lower("doi").contains("arxiv")
    return found.withColumn("citations", F.when(none, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long")).drop("_doi", "_n")
