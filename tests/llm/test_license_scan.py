import re

import duckdb

from lodestar.llm.license_scan import TEMPLATES, license_scan, license_sql

FILL = "some words that mean nothing at all in here "


def rows():
    out = [(0, None), (1, ""), (2, "Released under the MIT"), (3, FILL * 400)]
    for k, (_, t, _) in enumerate(TEMPLATES):
        w = t.split()
        out.append((10 + k, FILL * k + t + ". " + FILL * 3))
        out.append((100 + k, "\n".join([t.upper(), t, FILL])))
        out.append((200 + k, " ".join(w[: len(w) // 2])))
        out.append((300 + k, FILL + " ".join(x if i != len(w) - 2 else "OTHER" for i, x in enumerate(w)) + " " + FILL))
    out += [(400, FILL * 300 + TEMPLATES[4][1] + FILL * 200 + "Licensed under CC BY-NC 4.0"), (None, TEMPLATES[0][1]), (10, FILL), (400, FILL)]
    return out


def test_against_sql(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.licenses, r.n_licenses) for r in license_scan(docs).collect()), key=str)
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = sorted(duckdb.sql(license_sql()).fetchall(), key=str)
    assert got == want and {(10, "Apache-2.0", 1), (400, "CC-BY-NC-4.0,MIT", 2), (2, "", 0)} <= set(got)


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_neighbours_are_told_apart(spark):
    terms = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    rows = [(1, "This work is licensed under the GNU General Public License, version 2"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, terms.format("Affero ")), (4, terms.format("")), (5, terms.format("Lesser ")), (6, "This work is licensed under the GNU General Public License, version 9")]
    out = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame([(i, FILL + t + " " + FILL) for i, t in rows], "doc_id long, text string")).collect()}
    assert out == {1: "GPL-2.0", 2: "GPL-3.0", 3: "AGPL", 4: "GPL", 5: "LGPL", 6: ""}


def test_telling_words_are_in_their_notices():
    plain = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    for _, notice, telling in TEMPLATES:
        assert not telling or telling in plain(notice) and telling.count(" ") == 4
