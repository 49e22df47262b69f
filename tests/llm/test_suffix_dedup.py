import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm.suffix_dedup import suffix_dedup, text_names


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, short = word(length * 2), word(length // 2)
    rows = [None, "", "a", "ab" * length, "z" * (length + 1), "z" * length, "y" * (length - 1), "y" * (length - 1), common[: length - 20], word(30) + common[: length + 1] + word(9), word(5) + common[: length + 1]]
    for k in range(25):
        text = word(rng.randrange(5, 4 * length))
        if k % 3 == 0:
            text = text[:50] + common[rng.randrange(length) :] + text[50:]
        if k % 4 == 0:
            text += short + word(20) + short
        if k % 5 == 0:
            rows.append(text)
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at:]
        rows.append(text)
    return [(i if i != 7 else None, t) for i, t in enumerate(rows)] + [(3, rows[3])]


@pytest.mark.parametrize("seed,length,ranks,batch", [(1, 400, 10_000, 2 << 20), (2, 64, 10_000, 150), (3, 100, 1, 1000)])
def test_against_brute_force(spark, seed, length, ranks, batch):
    rows = corpus(seed, length)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rank int")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length, bucket_ranks=ranks, batch_bytes=batch).collect()]
    assert sorted(got, key=str) == brute(rows, length)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_names_of_a_text_are_independent(spark):
    """The second name is a hash of the text with a seed of its own, not of the first name."""
    df = spark.createDataFrame([("hello",), ("é" * 100,)], "raw string").select(F.col("raw").cast("binary").alias("raw"))
    seed = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
    for raw, high, low in df.select("raw", *text_names()).collect():
        assert high % 2**64 == xxhash.xxh64_intdigest(bytes(raw), 42) and low % 2**64 == xxhash.xxh64_intdigest(bytes(raw), seed)
