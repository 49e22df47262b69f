import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodestar.llm import simhash as module
from lodestar.llm.simhash import GrayIndex, dealt, fingerprint, gray_rank, print_links, simhash_components


def brute_print(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, most):
    root = {p: p for p in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(root)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= most:
                root[up(a)] = up(b)
    return {p: up(p) for p in items}


def brute(rows, size, most):
    prints = [brute_print(t, size) for _, t in rows]
    root = brute_roots(prints, most)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)]


def near(rng, n, centers, flips):
    """Prints about some centers, as numbers."""
    middle = [rng.getrandbits(64) for _ in range(centers)]
    out = set()
    while len(out) < n:
        x = rng.choice(middle)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 6, 40, 500]:
        for _ in range(20):
            text = "".join(rng.choice(["Ab", "é", "c", "\x1c", "D e"]) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
            for size in (1, 4, 5):
                assert fingerprint(text.encode(), size) == brute_print(text, size)
    # Equal numbers of ones and zeros aren't over half.
    assert fingerprint(b"a b", 1) == xxhash.xxh64_intdigest("a", 42) & xxhash.xxh64_intdigest("b", 42)


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(2_000))
    monkeypatch.setattr(module, "SLICE_HASHES", 77)
    assert fingerprint(text.encode(), 4) == brute_print(text, 4)


def test_gray_rank():
    order = np.argsort(gray_rank(np.arange(1 << 10, dtype=np.uint64)))
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("n,centers,most,fan", [(1, 1, 4, 8), (2, 1, 4, 2), (300, 3, 4, 8), (700, 40, 4, 3), (500, 500, 10, 8), (900, 2, 2, 5)])
def test_index_finds_all_links(n, centers, most, fan):
    rng = random.Random(n)
    prints = np.array(near(rng, n, centers, 9), np.uint64)
    bucket = np.array([rng.randrange(4) for _ in range(n)])
    order = np.lexsort((gray_rank(prints), bucket))
    prints, bucket = prints[order], bucket[order]
    got = [(int(a), int(b)) for x, y in GrayIndex(prints, bucket, fan).links(most) for a, b in zip(x, y, strict=True)]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_whole_groups_are_pruned():
    rng = random.Random(5)
    prints = np.array(near(rng, 2_000, 20, 4), np.uint64)
    prints = prints[np.argsort(gray_rank(prints))]
    compared = []
    count = np.bitwise_count
    try:
        np.bitwise_count = lambda x: compared.append(len(x)) or count(x)
        found = sum(len(a) for a, _ in GrayIndex(prints, np.zeros(len(prints), int)).links(4))
    finally:
        np.bitwise_count = count
    assert found and sum(compared) < 2_000**2 / 4


@pytest.mark.parametrize("bucket_rows", [16, 60, 5000])
def test_links_join_all_that_reach_each_other(spark, bucket_rows):
    rng = random.Random(7)
    prints = sorted({*near(rng, 400, 12, 12), *near(rng, 300, 1, 4), 0, 1, 2**63, 2**64 - 1})
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    links = [(r.u % 2**64, r.v % 2**64) for r in print_links(df, 4, bucket_rows).collect()]
    assert all((u ^ v).bit_count() <= 64 for u, v in links)
    want = brute_roots(prints, 4)
    root = {p: p for p in prints}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert want[u] == want[v]
        root[up(u)] = up(v)
    assert len({up(p) for p in prints}) == len(set(want.values()))
    sizes = dealt(df, 4, bucket_rows).groupBy("mask", "value").count()
    assert sizes.agg({"count": "max"}).first()[0] <= max(16, bucket_rows)


def test_a_bucket_that_two_rounds_deal_counts_once(spark):
    rows = dealt(spark.range(16).withColumnRenamed("id", "print"), 2, 4).collect()
    assert len(rows) == len(set(rows))
    sizes = Counter((r.mask, r.value) for r in rows)
    assert max(sizes.values()) == 4
    # Each bucket has all fingerprints with its bits.
    assert all(n == sum(p & mask == value for p in range(16)) for (mask, value), n in sizes.items())


@pytest.mark.parametrize("bucket_rows", [16, module.BUCKET_ROWS])
def test_against_brute_force(spark, bucket_rows):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 120))) for _ in range(12)]
    rows = [(None, None), (900, ""), (901, None), (902, " \n"), (903, "solo"), (904, "Solo"), (None, "nobody else has this text"), (905, base[0]), (905, base[0])]
    for i in range(160):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "\t", "\n "]).join(t)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, component int")
    got = [tuple(r) for r in simhash_components(df, 4, 4, bucket_rows).collect()]
    want = brute(rows, 4, 4)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[2] for r in want}) < 150


def test_empty_table_and_long_text(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d " * 200_000), (2, "A b c d\n" * 200_000), (3, "other")]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]
