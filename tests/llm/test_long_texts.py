"""Texts of megabytes beside short ones: whole texts count, and nothing ends early."""

import random

import pytest

from lodestar.llm.decontamination import decontamination
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.license_scan import license_scan
from lodestar.llm.mixing import mixing
from lodestar.llm.ngram_join import ngram_components
from lodestar.llm.toxicity import toxicity

WORDS = 400_000
NOTICE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
ITEM = "Anna has 12 apples and gives 5 of them to Peter, who already has 30 apples. How many apples does Peter have after this?"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(20_000)}" for _ in range(WORDS)]
    long = " ".join(words)
    near = words[:]
    near[7] = "other"
    texts = {1: long, 2: long.replace(" ", "\n", 50), 3: " ".join(near), 4: f"{long} {NOTICE}", 5: f"{long}\n{ITEM}", 6: "short text", 7: None, 8: "x" * (1 << 21)}
    return spark.createDataFrame([(i, t, "en", "s1", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def test_exact_copies(docs):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()}
    assert got[1] == got[2] == (1, 2) and all(got[i] == (i, 1) for i in (3, 4, 5, 6, 7, 8))


def test_near_copies(docs):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_components(docs, size=3, percent=90).collect()}
    assert {got[i][0] for i in (1, 2, 3, 4, 5)} == {1} and got[1][1] == got[2][1] > 390_000
    assert got[6] == (6, 1) and got[7] == (7, 0) and got[8] == (8, 1)


def test_a_notice_at_the_end(docs):
    got = {r.doc_id: r.n_licenses for r in license_scan(docs).collect()}
    assert got[4] == 1 and sum(got.values()) == 1 and len(got) == 8


def test_an_item_at_the_end(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in decontamination(docs, items).collect() if r.contaminated} == {5}


def test_sizes(docs):
    got = {r.doc_id: (r.size, r.taken) for r in mixing(docs).collect()}
    assert [got[i][0] for i in range(1, 9)] == [WORDS, WORDS, WORDS, WORDS + len(NOTICE.split()), WORDS + len(ITEM.split()), 2, 0, 1]
    assert all(taken <= 2 * size for size, taken in got.values())


def test_scores(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i == 6)) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    assert set(got) == set(range(1, 9)) and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
