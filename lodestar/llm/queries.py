"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontamination import decontamination
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .license_scan import license_scan, license_sql
from .mixing import mixing
from .ngram_join import ngram_components
from .periodic_runs import periodic_runs, run_digests, with_periods
from .sharding import sharded
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "licenses", "n_licenses")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, most=4)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_html_extract, op3_exact_dedup, op4_toxicity, op5_mixing, op6_license_scan, op7_suffix_dedup, op8_ngram_jaccard_join, op9_sharding, op10_benchmark_decontamination, op11_periodic_runs, op12_collocations, op13_simhash_components)}

ORACLE: dict[str, str] = {
    "op6_license_scan": license_sql(),
    "op3_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as plain from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(plain) as text_sha256
from d window w as (partition by plain)
""",
    "op12_collocations": r"""
with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from d),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3)) t(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as a from g group by lang, k, phrase),
n as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= 10),
cut as (select lang, k, phrase, a, w, unnest(range(1, k)) as i from c),
parts as (select lang, phrase, a, i, array_to_string(w[1:i], ' ') as head, array_to_string(w[i + 1:k], ' ') as rest from cut),
s as (select p.lang, p.phrase, p.a, p.i, x.a as l, y.a as r, (cast(1000000 as hugeint) * p.a * p.a) // (cast(x.a as hugeint) * y.a) as score from parts p join f x on x.lang = p.lang and x.phrase = p.head join f y on y.lang = p.lang and y.phrase = p.rest),
best as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, i) = 1),
held as (select distinct b.lang, b.phrase from best b join c on c.lang = b.lang and contains(concat(' ', c.phrase, ' '), concat(' ', b.phrase, ' ')) and c.phrase <> b.phrase and 100 * c.a >= 50 * b.a),
kept as (select b.* from best b anti join held using (lang, phrase)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join n using (lang) where rank <= 2000
""",
    "op8_ngram_jaccard_join": r"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
g as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) end as g from d),
s as (select r, len(g) as n, unnest(g) as x from g),
p as (select a.r as u, b.r as v, any_value(a.n) as m, any_value(b.n) as n, count(*) as c from s a join s b on a.x = b.x and a.r <> b.r and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90 group by a.r, b.r),
l as (select u, v from p where 100 * c >= 90 * (m + n - c)),
reach as (select r as u, r as v from d union select reach.u, l.v from reach join l on reach.v = l.u)
select g.doc_id, cast(len(g.g) as bigint) as n_shingles, case when len(g.g) = 0 then g.doc_id else min(o.doc_id) end as component_id from reach join g on g.r = reach.u join g o on o.r = reach.v group by g.r, g.doc_id, len(g.g)
""",
}
