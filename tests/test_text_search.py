"""Transliteration, and search over encoded texts against a restated one."""

import hashlib
import re

import pytest

from lodestar.functions.latin import ascii_of, transliterated
from lodestar.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text,want",
    [("Ångström naïve ﬁ", "Angstrom naive fi"), ("Straße Ørsted Łódź", "Strasse Orsted Lodz"), ("Þór Æon œuvre", "Thor Aeon oeuvre"), ("α-β ΘΩ ς", "a-b ThO s"), ("Щука ёж Київ", "Shchuka iozh Kiyiv"), ("“a” – b… ½ x² µ", "\"a\" - b... 1/2 x2 m"), ("日本 a", " a"), ("plain", "plain"), ("é́", "e")],
)
def test_transliteration(spark, text, want):
    assert "".join(map(ascii_of, text)) == want
    assert spark.createDataFrame([(text,), (None,)], "t string").select(transliterated("t")).collect()[0][0] == want


def code(text):
    words = re.findall(r"\w+", (text or "").lower())
    votes = [0] * 128
    for w in words:
        raw = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=16).digest())
        for i in range(128):
            votes[i] += raw >> (127 - i) & 1
    return sum(1 << (127 - i) for i in range(128) if 2 * votes[i] > len(words))


def test_search_of_texts(spark):
    docs = {r.doc_id: code(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = sorted(((c ^ code(item.strip())).bit_count(), i) for i, c in docs.items())[:10]
    assert [(r.dist, r.id) for r in QUERIES["text_search"](spark, SF).collect()] == near
    want = {(q, i, d) for q in docs if q % 100 == 0 for d, i in sorted(((c ^ docs[q]).bit_count(), i) for i, c in docs.items())[:10]}
    assert {(r.query_id, r.id, r.dist) for r in QUERIES["text_search_all"](spark, SF).collect()} == want
