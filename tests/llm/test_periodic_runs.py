import hashlib
import random
import zlib

import pytest

from lodestar.llm import periodic_runs as module
from lodestar.llm.periodic_runs import overlap, periodic_runs, run_digests, segment_runs, with_periods


def brute_runs(s, least, times):
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 6, 4)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_overlap():
    assert overlap(6, 4) == 5
    for least, times in [(6, 4), (2, 2), (9, 2), (5, 3), (12, 5)]:
        assert overlap(least, times) == max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, 200)))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_a_segment(seed):
    rng = random.Random(seed)
    least, times = rng.choice([(6, 4), (2, 2), (4, 3), (6, 2)])
    s = []
    while len(s) < 150:
        s += rng.choice([[rng.randrange(3)], [rng.randrange(2) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)])
    assert segment_runs(s, least, times) == brute_runs(s, least, times)


def texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(12)):
            part = [rng.choice("ab  é\x1c x1") .strip() or "w" for _ in range(rng.randrange(1, 7))]
            words += part * rng.choice([1, 1, 2, 3, 4, 5, 9])
        yield rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)


@pytest.mark.parametrize("slice_bytes,split", [(module.SLICE_BYTES, module.SPLIT_BYTES), (50, 3)])
def test_against_brute_force(spark, monkeypatch, slice_bytes, split):
    # Constants are read in the workers, so they are given by the functions' globals.
    monkeypatch.setattr(module, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(module, "SPLIT_BYTES", split)
    rows = [(i, t) for i, t in enumerate(texts(1))] + [(None, "a a a a a a a"), (None, None), (5, ""), (7, " \n"), (8, None), (9, "b a a a a a a"), (9, "b a a a a a a")]
    rows += [(1000 + i, " ".join(str(j % 1000) for j in range(300))) for i in range(60)]
    # Those that repeat a stretch, by the digest of their id.
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, runs string, length int")
    got = [tuple(r) for r in run_digests(periodic_runs(with_periods(df))).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in got)
    local = list(module._found([(t or "").encode() for _, t in rows], 6, 4))
    assert [r for r, _ in local] == [brute_runs((t or "").encode().split(), 6, 4) for _, t in rows]


def test_texts_and_runs(spark):
    df = spark.createDataFrame([(1, "x a b a b a b\na b y"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in periodic_runs(df).collect()) == [(1, [(1, 8, 2)], "x a b y"), (2, [], "")]


def test_long_text(spark):
    words = ["q"] * 300_000 + [str(i) for i in range(300_000)] + ["r", "s", "t"] * 100_000
    got = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 300_000, 1), (600_000, 300_000, 3)]
    assert got.text == " ".join(["q", *words[300_000:600_003]])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run_digests(periodic_runs(with_periods(df))).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, min_exponent=1)
