"""Date expressions. Dates of papers are strings: a day, a bare year, or nothing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English month names as records abbreviate them.
MONTHS = dict(zip("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), range(1, 13), strict=True))


def paper_date(c: Column) -> Column:
    """The day, or the first of January of a bare year; null for anything else."""
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")), F.when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd")))


def from_parts(year: Column, month: Column, day: Column, numeric_months: bool = False) -> Column:
    """A day from a record's parts; null unless the year is all digits.

    Month names count, others are January (numbers too, unless ``numeric_months``); a day that isn't a number is the first; what no calendar has is the year's first day.
    """
    y = F.trim(year)
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(f"{v:02d}")) for k, v in MONTHS.items()))
    m = F.coalesce(F.element_at(names, month), F.when(month.rlike(r"^\d{1,2}$"), F.lpad(month, 2, "0")) if numeric_months else F.lit(None), F.lit("01"))
    d = F.when(F.trim(day).rlike(r"^\d+$"), F.lpad(F.trim(day), 2, "0")).otherwise("01")
    text = F.concat_ws("-", y, m, d)
    return F.when(y.rlike(r"^\d+$"), F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"), F.concat(y, F.lit("-01-01"))))


def cascade(levels: list[tuple[Column, Column, Column]], free_text: Column, numeric_months: bool = False) -> Column:
    """The first level with a year; then a year of 1900 to 2099 in the free text; then nothing."""
    year = F.regexp_extract(F.coalesce(free_text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(*(from_parts(*parts, numeric_months) for parts in levels), year)


def month_blocks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``block_start, block_end, name``: months from the start, the last one cut at the end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("block_start"))
    out = days.withColumn("block_end", F.least(F.date_sub(F.add_months("block_start", 1), 1), F.lit(end).cast("date")))
    return out.withColumn("name", F.concat_ws("_", F.date_format("block_start", "yyMMdd"), F.date_format("block_end", "yyMMdd")))
