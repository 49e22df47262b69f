"""Text, identifier and export expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .latin import transliterated

EDGE_SPACE = r"^\s+|\s+$"

#: Common character references, for text without others.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """All character references decoded."""
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def plain_ascii(c: Column, full: bool = True) -> Column:
    """Display form: references decoded, tags and what isn't printable ASCII (line breaks too) removed, blanks squeezed; null is empty.

    Every reference is decoded, by a vectorised UDF; ``full=False`` decodes the common ones by expressions, for text that has no others.
    """
    out = F.coalesce(c, F.lit(""))
    if full:
        out = unescaped(out)
    else:
        for entity, char in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), r"[^\x20-\x7E]", "")
    return F.trim(F.regexp_replace(out, " +", " "))


#: The names of references to printable ASCII characters.
ASCII_NAMES = dict(
    zip(
        "excl quot num dollar percnt apos lpar rpar ast plus comma period sol colon semi lt equals gt quest commat lsqb bsol rsqb Hat lowbar grave lcub verbar rcub".split(),
        "! \" # $ % ' ( ) * + , . / : ; < = > ? @ [ \\ ] ^ _ ` { | }".split(),
        strict=True,
    )
)


def decoded(c: Column) -> Column:
    """Character references decoded by expressions, for text of which only printable ASCII is kept: those to other characters, and names that aren't in ``ASCII_NAMES``, are removed."""

    def numbered(part: Column) -> Column:
        ten, sixteen = F.regexp_extract(part, "^([0-9]{1,9})", 1), F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,7})", 1)
        code = F.when(ten != "", ten.cast("long")).when(sixteen != "", F.conv(sixteen, 16, 10).cast("long"))
        rest = F.regexp_replace(part, "^(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,7});?", "")
        return F.when(code.isNull(), F.concat(F.lit("&#"), part)).otherwise(F.concat(F.when(code == 38, "\x01").when(code.between(32, 126), F.chr(code)).otherwise(""), rest))

    parts = F.split(c, "&#")
    out = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), numbered), ""))
    for name, char in ASCII_NAMES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.regexp_replace(F.replace(out, F.lit("&amp;"), F.lit("\x01")), "&[A-Za-z][A-Za-z0-9]{1,30};", "")
    return F.when(c.contains("&"), F.replace(out, F.lit("\x01"), F.lit("&"))).otherwise(c)


def display_form(c: Column) -> Column:
    """``plain_ascii`` in generated code alone."""
    out = F.regexp_replace(F.regexp_replace(decoded(F.coalesce(c, F.lit(""))), r"<[^>]+>", ""), r"[^\x20-\x7E]", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def one_line(c: Column, transliterate: bool = False) -> Column:
    """Runs of white space as one space, no space at the edges; in ASCII on request."""
    return F.trim(F.regexp_replace(transliterated(c) if transliterate else c, r"\s+", " "))


def signature(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))


def embedding_text(title: Column, abstract: Column, prefix: str = "") -> Column:
    """What is encoded of a paper; some sources put an instruction before it."""
    return F.concat(F.lit(prefix), F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def clean_doi(doi: Column) -> Column:
    """The bare DOI where the text holds one; an arXiv address stays; null is empty."""
    bare = F.regexp_extract(doi, r"(10\.\d{4,9}/\S+)", 1)
    return F.when(doi.isNull(), "").when(doi.contains("arxiv.org"), doi).when(bare != "", bare).otherwise(doi)


def full_text_link(source: Column, doi: Column) -> Column:
    address = F.concat(F.lit("https://doi.org/"), doi)
    return F.when(F.lower(source) == "pubmed", F.when(doi.contains("10."), address)).when(doi.contains("arxiv.org"), doi).when(F.length(doi) > 0, address)


def doi_link(doi: Column) -> Column:
    return F.when(doi.contains("arxiv.org"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi))


def title_text(page: Column) -> Column:
    """The text of a page's or record's title, tags inside it removed and runs of white space as one space; empty without one."""
    inner = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return one_line(F.regexp_replace(inner, r"<[^>]+>", " "))


def source_prefix(source: Column, prefixes: dict[str, str]) -> Column:
    """The instruction that a source's documents are encoded with; none for sources without one."""
    out = F.lit("")
    for name, prefix in prefixes.items():
        out = F.when(source == name, F.lit(prefix)).otherwise(out)
    return out


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1)


def questions(reply: Column, n: int = 4) -> Column:
    """The first lines of a reply that aren't blank."""
    return F.slice(F.filter(F.transform(F.split(reply, "\n"), stripped), lambda s: s != ""), 1, n)


def bibtex(papers: DataFrame, index: str = "idx") -> DataFrame:
    """``index, entry``: a citation record for each of the ranked papers."""
    text = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default))
    authors = F.regexp_replace(F.replace(text("authors", "Unknown"), F.lit(";"), F.lit(" and")), r"[\[\]']", "")
    year = F.regexp_extract(text("date"), r"\d{4}", 0)
    year = F.when(year != "", year).otherwise("n.d.")
    first = F.regexp_replace(F.split_part(F.split_part(authors, F.lit(" "), F.lit(1)), F.lit(","), F.lit(1)), r"(?U)\W+", "")
    word = F.get(F.filter(F.split(F.regexp_replace(text("title", "No Title"), r"(?U)[^\w\s]", ""), r"\s+"), lambda w: w != ""), 0)
    journal = F.when(F.lower(text("journal")).isin("", "nan"), F.initcap(F.lower(text("source")))).otherwise(text("journal"))
    key = F.concat(F.when(first != "", first).otherwise("Anon"), year, F.coalesce(word, F.lit("Untitled")), F.lit("_"), F.col(index).cast("string"))
    field = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("},\n"))
    doi = stripped(F.col("doi"))
    source = F.when(F.col("doi").contains("10."), F.concat(field("doi", doi), field("url", F.concat(F.lit("https://doi.org/"), doi)))).otherwise("")
    entry = F.concat(F.lit("@article{"), key, F.lit(",\n"), field("author", authors), field("title", text("title", "No Title")), field("journal", journal), field("year", year), source, F.lit("}\n"))
    return papers.select(index, entry.alias("entry"))


def prompt_context(ranked: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """One row ``context``: the first ``n`` papers, numbered, in rank order. ``n`` bounds what is gathered."""
    top = ranked.orderBy(rank).limit(n)
    line = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.coalesce("title", F.lit("No Title")), F.lit("\n"), F.coalesce("abstract", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l"))))
    return top.agg(F.array_join(F.transform(rows, lambda s: s["l"]), "\n\n").alias("context"))


def chat_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversation, history``: the turns of each conversation in order, one line each."""
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.coalesce(F.col(text), F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(rows, lambda s: s["l"]), "\n").alias("history"))


def _numbered(rank: str, line: Column, between: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l"))))
    return F.coalesce(F.array_join(F.transform(rows, lambda s: s["l"]), between), F.lit(""))


def paper_prompt(ranked: DataFrame, instruction: str, n: int = 8, rank: str = "rank", labelled: bool = True) -> DataFrame:
    """One row ``prompt``: an instruction, then title and abstract of the first ``n`` papers in rank order; for a summary with labels, for questions without."""
    title, abstract = F.coalesce("title", F.lit("No Title" if labelled else "")), F.coalesce("abstract", F.lit("No Abstract" if labelled else ""))
    line = F.concat(F.lit("Paper "), F.col(rank).cast("string"), F.lit(": "), title, F.lit("\nAbstract: "), abstract) if labelled else F.concat(title, F.lit("\n"), abstract)
    top = ranked.orderBy(rank).limit(n)
    return top.agg(F.concat(F.lit(instruction + "\n\n"), _numbered(rank, line, "\n\n" if labelled else "\n")).alias("prompt"))


def chat_prompt(turns: DataFrame, ranked: DataFrame, instruction: str, message: str, n: int = 15, rank: str = "rank") -> DataFrame:
    """``conv_id, prompt`` for each conversation: instruction, numbered papers, the turns so far and the user's message."""
    context = prompt_context(ranked, n, rank)  # one row
    text = F.concat_ws("\n\n", F.lit(instruction), F.col("context"), F.concat(F.col("history"), F.lit(f"\nUser: {message}\nAssistant:")))
    return chat_history(turns).crossJoin(F.broadcast(context)).select("conv_id", text.alias("prompt"))
