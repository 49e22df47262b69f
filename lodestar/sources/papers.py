"""Readers and writers of paper records."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import cascade
from ..functions.text import display_form, file_stem, one_line

ARXIV = "id string, title string, abstract string, authors string, update_date string, categories string"
#: Rows of a paper file.
FILE_ROWS = 25_000
#: Rows of a row group, bytes of a page.
GROUP_ROWS, PAGE_BYTES = 10_000, 8 << 20
#: More than any header of a packed matrix takes.
HEAD_BYTES = 4096
RESERVED = ("accepted", "epublish", "aheadofprint", "ppublish")


def arxiv_snapshot(spark: SparkSession, path: str, transliterate: bool = False, where: str | None = None, most: int | None = None) -> DataFrame:
    """JSON Lines records; malformed lines are passed over, missing fields are empty. ``where`` is a condition on the fields as they are in the file, ``most`` a cap on the rows that meet it."""
    rows = spark.read.schema(ARXIV).option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull())
    rows = rows.filter(where) if where else rows
    rows = rows if most is None else rows.limit(most)
    tidy = {c: one_line(F.coalesce(F.col(c), F.lit("")), transliterate) for c in ("title", "abstract", "authors")}
    return rows.select("id", *(tidy[c].alias(c) for c in tidy), F.coalesce("update_date", F.lit("")).alias("date"), "categories", F.concat(F.lit("https://arxiv.org/abs/"), "id").alias("doi"), F.coalesce("categories", F.lit("arXiv")).alias("journal"))


def preprint_blocks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Blocks of JSON arrays; every column is text, nulls stay null. Where ``columns`` are named, files are read once; otherwise they are read before to find them."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(", ".join(f"`{c}` string" for c in columns)) if columns else reader).json(path)
    return rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns if c != "_corrupt_record"))


_DAY = "Year: string, Month: string, Day: string"
#: The parts of an article that are read. A part with tags in its text is text with its tags.
ARTICLE = f"""MedlineCitation struct<PMID: struct<_VALUE: string, _Version: string>, DateCompleted: struct<{_DAY}>,
 Article: struct<Journal: struct<JournalIssue: struct<PubDate: struct<{_DAY}, MedlineDate: string>>, Title: string>, ArticleTitle: string, Abstract: string,
  AuthorList: struct<Author: array<struct<ForeName: string, MiddleName: string, LastName: string>>>, PublicationTypeList: struct<PublicationType: array<string>>, ArticleDate: array<struct<_DateType: string, {_DAY}>>>,
 MedlineJournalInfo: struct<MedlineTA: string>, ChemicalList: struct<Chemical: array<struct<NameOfSubstance: string>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string, QualifierName: array<string>>>>,
 KeywordList: array<struct<Keyword: array<string>>>>, PubmedData struct<History: struct<PubMedPubDate: array<struct<_PubStatus: string, {_DAY}>>>, ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>, malformed string"""
#: A tag, with the attributes it may have.
TAG = r"</?[A-Za-z][^<>]*>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``file, a`` for each article of XML files, gzipped or not: files are split at the end of each article, and an article is parsed alone by the built-in XML parser, so a malformed one (``a.malformed`` is its text) costs no other."""
    rows = spark.read.text(path, lineSep="</PubmedArticle>").select(F.col("_metadata.file_path").alias("file"), "value")
    begin = F.regexp_instr("value", F.lit(r"<PubmedArticle[\s>]"))
    xml = F.concat(F.substring("value", begin, F.length("value")), F.lit("</PubmedArticle>"))
    return rows.filter(begin > 0).select("file", F.from_xml(xml, ARTICLE, {"rowTag": "PubmedArticle", "columnNameOfCorruptRecord": "malformed"}).alias("a"))


def failed_articles(spark: SparkSession, path: str) -> DataFrame:
    """``file, articles, failed``: how many articles each file has, and how many of them can't be parsed."""
    return articles(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("articles"), F.count("a.malformed").alias("failed"))


def pubmed_xml(spark: SparkSession, path: str, prefer_full_title: bool = False, numeric_months: bool = False) -> DataFrame:
    """Articles of XML files as papers, by expressions; those that can't be parsed are passed over (``failed_articles`` counts them).

    ``prefer_full_title`` takes the journal's full title where there is one, otherwise the abbreviation counts.
    """
    c, d = "a.MedlineCitation", "a.PubmedData"
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    some = lambda x: F.filter(x, lambda v: v.isNotNull() & (v != ""))
    trimmed = lambda x: F.array_join(F.transform(some(listed(x)), F.trim), "; ")

    def part(at: Column) -> tuple[Column, Column, Column]:
        return at["Year"], at["Month"], at["Day"]

    def one(list_: str, attribute: str, value: str) -> Column:
        return F.get(F.filter(F.col(list_), lambda x: x[attribute] == value), F.lit(0))

    def line(x: Column) -> Column:
        label = F.trim(F.regexp_extract(x, r"^\s*<AbstractText[^<>]*\bLabel=\"([^\"]*)\"", 1))
        own = display_form(F.regexp_replace(F.regexp_replace(x, r"^\s*<AbstractText[^<>]*>", ""), r"[\r\n\t]+", " "))
        return F.when(label != "", F.concat(label, F.lit(": "), own)).otherwise(own)

    parts = F.filter(F.split(text(f"{c}.Article.Abstract"), "</AbstractText>"), lambda x: x.contains("<AbstractText"))
    people = F.transform(F.col(f"{c}.Article.AuthorList.Author"), lambda a: F.array_join(some(F.array(*(display_form(a[n]) for n in ("ForeName", "MiddleName", "LastName")))), " "))
    mesh = F.transform(
        F.filter(F.col(f"{c}.MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"].isNotNull()),
        lambda h: F.concat(F.trim(h["DescriptorName"]), F.when(F.size(some(listed(h["QualifierName"]))) > 0, F.concat(F.lit(" ["), F.array_join(F.transform(some(listed(h["QualifierName"])), F.trim), ", "), F.lit("]"))).otherwise("")),
    )
    dates = [F.col(f"{c}.Article.Journal.JournalIssue.PubDate"), one(f"{c}.Article.ArticleDate", "_DateType", "Electronic"), F.col(f"{c}.DateCompleted"), *(one(f"{d}.History.PubMedPubDate", "_PubStatus", s) for s in RESERVED)]
    names = (f"{c}.MedlineJournalInfo.MedlineTA", f"{c}.Article.Journal.Title")
    journal = F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in (reversed(names) if prefer_full_title else names)), F.lit(""))
    rows = articles(spark, path).filter(F.col("a.malformed").isNull())
    return rows.select(
        display_form(F.get(F.filter(F.col(f"{d}.ArticleIdList.ArticleId"), lambda x: (x["_IdType"] == "doi") & (x["_VALUE"] != "")), F.lit(0))["_VALUE"]).alias("doi"),
        display_form(F.regexp_replace(text(f"{c}.Article.ArticleTitle"), TAG, " ")).alias("title"),
        F.array_join(some(listed(people)), "; ").alias("authors"),
        cascade([part(x) for x in dates], F.col(f"{c}.Article.Journal.JournalIssue.PubDate.MedlineDate"), numeric_months).alias("date"),
        text(f"{c}.PMID._Version").alias("version"), display_form(F.get(F.col(f"{c}.Article.PublicationTypeList.PublicationType"), F.lit(0))).alias("type"), display_form(journal).alias("journal"),
        F.trim(F.array_join(F.transform(parts, line), "\n")).alias("abstract"), F.trim(text(f"{c}.PMID._VALUE")).alias("pmid"),
        F.array_join(listed(mesh), "; ").alias("mesh_terms"), trimmed(F.flatten(F.col(f"{c}.KeywordList.Keyword"))).alias("keywords"), trimmed(F.col(f"{c}.ChemicalList.Chemical.NameOfSubstance")).alias("chemicals"),
    )


def npy_codes(spark: SparkSession, path: str) -> DataFrame:
    """``stem, local_idx, c0, c1, ...`` of packed bit matrices; a file whose width isn't that of the first is passed over. Files are read whole, one to a task, and have 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    # Only the head of the first file reaches the driver.
    first = files.orderBy("path").select(F.substring("content", 1, HEAD_BYTES).alias("head")).first()
    if first is None:
        return spark.createDataFrame([], "stem string, local_idx long, c0 long")
    head = io.BytesIO(bytes(first.head))
    version = np.lib.format.read_magic(head)
    shape, _, _ = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
    width = shape[1] if len(shape) == 2 else 0
    count = -(-width // 8)
    columns = [f"c{k}" for k in range(count)]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stem, content in zip(frame["stem"], frame["content"], strict=True):
                a = np.load(io.BytesIO(content))
                if a.ndim == 2 and a.shape[1] == width and len(a):
                    padded = np.zeros((len(a), 8 * count), np.uint8)
                    padded[:, :width] = a
                    out = pd.DataFrame(padded.view(">i8").astype(np.int64), columns=columns)
                    out.insert(0, "local_idx", np.arange(len(a)))
                    out.insert(0, "stem", stem)
                    yield out

    return files.select(file_stem(F.col("path")).alias("stem"), "content").mapInPandas(load, "stem string, local_idx long, " + ", ".join(f"{c} long" for c in columns))


def write_papers(papers: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS, partition: str | None = "source", group_rows: int = GROUP_ROWS, page_bytes: int = PAGE_BYTES) -> None:
    """Sorted by date inside each file, so row groups have narrow ranges; zstd, dictionaries and statistics; bounded rows a file and a row group."""
    out = papers.sortWithinPartitions("date") if "date" in papers.columns else papers
    writer = out.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", file_rows)
    writer = writer.option("parquet.block.row.count.limit", group_rows).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", "true")
    (writer.partitionBy(partition) if partition in papers.columns else writer).parquet(path)


def write_lines(entries: DataFrame, path: str, column: str = "entry") -> None:
    entries.select(column).write.mode("overwrite").text(path)
