"""License notices by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are lower-cased runs of letters and digits, shingles are hashes of five of them. A template of T shingles is sought in windows of 2 T shingles that
start every T, so a notice lies inside one whole. A band is one permutation. A window that holds 80 % of a template has a similarity of 0.36 or more to it, so of
``BANDS`` = 31 bands one at least collides with a probability above 1 - 1e-6. A band can collide only where the window holds the template's smallest shingle of that permutation:
documents are scanned once for these few shingles, and only windows that hold one have their minima computed. Windows with a colliding band are checked for
the exact share of the template's shingles that they contain, and for the five words that tell the license from its neighbours (a version, "Lesser", "Affero"), where it has any.

Templates are fixed and few, so they are broadcast; no more than ``MOST_TEMPLATES`` are taken. Null texts and texts of fewer than five words hold none. Repeated rows and null ids keep a row each;
other columns don't matter. A text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SHARE, BANDS = 5, 0.8, 31
#: Templates whose minima are broadcast: some 100 kB for each with 400 words.
MOST_TEMPLATES = 500

# Notices by license, and five words in a row that a window has to hold.
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', ""),
    ("MIT", "Released under the MIT License", ""),
    ("MIT", "Licensed under the MIT License", ""),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', ""),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("BSD", "Licensed under the BSD 3-Clause License", "the bsd 3 clause license"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "general public license version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "general public license version 2"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "of the gnu general public"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license v 2"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4 0 international"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4 0 international"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ""),
]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, whatever the optimizer moves, and use it in ``then``."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of each five words; none for fewer."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, some).otherwise(F.array().cast("array<long>"))


def _minima(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """``template, license, hashes, needed, band, element, least``: the smallest shingle of each template in each permutation, and the shingle that it needs."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    table = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, notice string, telling string")
    needed = F.get(let(words("telling"), shingles), F.lit(0))
    table = table.select("template", "license", F.array_distinct(let(words("notice"), shingles)).alias("hashes"), needed.alias("needed")).filter(F.size("hashes") > 0)
    table = table.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    ranked = F.array_min(F.transform("hashes", lambda x: F.struct(F.xxhash64(x, F.col("band")).alias("least"), x.alias("element"))))
    return table.withColumn("best", ranked).select("template", "license", "hashes", "needed", "band", "best.element", "best.least")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, licenses, n_licenses, notices`` for every row: names in order, joined by a comma; ``notices`` has license, containment and the first word of its window."""
    spark = docs.sparkSession
    minima = _minima(spark, templates)
    known = minima.agg(F.sort_array(F.collect_set("element")), F.max(F.size("hashes"))).first()
    elements, widest = list(known[0]), 2 * (known[1] or 0)

    def hits(h: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(x.isin(elements), i)), lambda i: i.isNotNull())
        low = lambda i: F.greatest(i - widest, F.lit(0))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.get(h, i).alias("element"), low(i).alias("low"), F.slice(h, low(i) + 1, F.lit(2 * widest + 1)).alias("near")))

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    found = held.select("doc_id", "mark", F.explode_outer(let(words("text"), lambda w: let(shingles(w), hits))).alias("hit")).filter("hit is not null").select("doc_id", "mark", "hit.*")
    tried = found.join(F.broadcast(minima), "element").withColumn("step", F.size("hashes"))
    tried = tried.withColumn("window", F.explode(F.array(F.floor(F.col("at") / F.col("step")), F.floor(F.col("at") / F.col("step")) - 1))).filter("window >= 0")
    start = (F.col("window") * F.col("step")).cast("int")
    tried = tried.withColumn("start", start).withColumn("inside", F.slice("near", F.greatest(F.col("start") - F.col("low") + 1, F.lit(1)), 2 * F.col("step")))
    collide = F.array_min(F.transform("inside", lambda x: F.xxhash64(x, F.col("band")))) == F.col("least")
    share = F.size(F.array_intersect("hashes", "inside")) / F.size("hashes")
    told = F.col("needed").isNull() | F.array_contains("inside", F.col("needed"))
    notices = tried.filter(collide).withColumn("share", share).filter((F.col("share") >= SHARE) & told)
    best = notices.groupBy("doc_id", "mark", "license").agg(F.max("share").alias("containment"), F.min("start").alias("first_word"))
    by_doc = best.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.sort_array(F.collect_list(F.struct("license", "containment", "first_word"))).alias("notices"))
    both = held.select("doc_id", "mark").join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    names = F.coalesce(F.array_join(F.transform("notices", lambda n: n["license"]), ","), F.lit(""))
    return both.select("doc_id", names.alias("licenses"), F.coalesce(F.size("notices"), F.lit(0)).alias("n_licenses"), "notices")


def license_sql(templates: list[tuple[str, str, str]] = TEMPLATES) -> str:
    """DuckDB SQL of ``doc_id, licenses, n_licenses``: every window's containment, without bands."""
    quoted = ", ".join("({}, '{}', '{}', '{}')".format(k, n, t.replace("'", "''"), needed) for k, (n, t, needed) in enumerate(templates))
    grams = "list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string({0}[i:i+4], ' '))"
    split = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
with t as (select k, license, needed, list_distinct({grams.format("w")}) as g from (select k, license, needed, {split.format("notice")} as w from (values {quoted}) v(k, license, notice, needed))),
tg as (select k, license, needed, len(g) as n, unnest(g) as gram from t),
d as (select row_number() over () as r, doc_id, {split.format("text")} as w from documents),
dg as (select r, unnest({grams.format("w")}) as gram, unnest(range(0, greatest(len(w) - 4, 0))) as pos from d),
hit as (select r, k, license, needed, n, gram, pos from dg join tg using (gram)),
win as (select r, k, license, needed, n, gram, pos // n as w from hit union all select r, k, license, needed, n, gram, pos // n - 1 as w from hit where pos // n > 0),
ok as (select distinct r, license from (select r, license, k, n, w, count(distinct gram) as c, bool_or(needed = '' or gram = needed) as told from win group by r, license, k, n, w) where c >= {SHARE} * n and told),
l as (select r, string_agg(license, ',' order by license) as licenses, count(*) as n_licenses from ok group by r)
select doc_id, coalesce(licenses, '') as licenses, cast(coalesce(n_licenses, 0) as integer) as n_licenses from d left join l using (r)
"""
