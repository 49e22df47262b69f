import random
import re

import numpy as np
import pytest

from lodestar.llm.components import components
from lodestar.llm.ngram_join import Classes, _Hashes, _sets, ngram_components, ngram_links, node_of, shingles, sketch_keys


def sets_of(rows, size):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return sets


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    low = {}
    for (i, _), c, s in zip(rows, comp, sets, strict=True):
        if i is not None and s:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, len(s), low.get(c) if s else i) for (i, _), c, s in zip(rows, comp, sets, strict=True)), key=str)


def corpus(seed, size):
    rng, texts = random.Random(seed), [None, "", "  ", "a", "A", "a b", "A\tB", "a b c", "c b a", "é É", "É é"]
    for _ in range(25):
        words = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([4, 9, 12, 20, 30, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            w = list(words)
            for _ in range(rng.randrange(1 + len(w) // 30)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["z"], [w[at], "y"]])
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, "lost words here"), (5, "a b c"), (5, "a b c")]


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80)])
def test_against_brute_force(spark, seed, size, percent):
    rows = corpus(seed, size)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    got = sorted((tuple(r) for r in ngram_components(df, size, percent).collect()), key=str)
    assert got == brute(rows, size, percent)


@pytest.mark.parametrize("seed,size,percent", [(3, 3, 90), (4, 5, 80)])
def test_all_links_are_told(spark, monkeypatch, seed, size, percent):
    monkeypatch.setattr("lodestar.llm.ngram_join.BLOCK_NODES", 6)
    rows = corpus(seed, size)
    words = [f"w{k}" for k in range(300)]
    rows += [(2000 + k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(0, 300, 20)]  # different texts, all linked
    sets = [frozenset(s) for s in sets_of(rows, size)]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    counts = sorted(((i, len(s), sum(linked(s, t) for t in sets) - bool(s)) for (i, _), s in zip(rows, sets, strict=True)), key=str)
    members, links = ngram_links(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int"), size, percent)
    members, links = members.collect(), [tuple(r) for r in links.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in members), key=str) == counts
    distinct = list(set(sets) - {frozenset()})
    assert len(set(links)) == len(links) == sum(linked(a, b) for i, a in enumerate(distinct) for b in distinct[:i])
    assert all(u < v for u, v in links) and {x for p in links for x in p} <= {r.class_id for r in members}


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sizes_are_neighbours():
    for percent in (80, 90):
        c = Classes(percent)
        for n in range(1, 3000):
            assert 0 <= c.of(n * 100 // percent) - c.of(n) <= 1
            assert c.apart(c.of(n)) >= c.differ(n)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key_and_others_few(percent):
    rng = np.random.default_rng(percent)
    classes, shared, pairs = Classes(percent), 0, 0
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 17, 20, 31, 50, 80, 130, 300, 900] * 12:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        gone = rng.integers(0, classes.differ(n) + 1)  # of the larger set, so that the smaller one has `percent` of it
        kept = rng.permutation(a)[gone:]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, rng.integers(0, gone + 1), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(sketch_keys(a, classes), sketch_keys(b, classes)))
        other = rng.integers(0, 2**64, n, np.uint64)
        pairs += 1
        shared += bool(len(np.intersect1d(sketch_keys(a, classes), sketch_keys(np.unique(other), classes))))
    assert shared <= pairs // 100  # empty words don't make buckets


def test_texts_come_by_filter_or_by_join(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"a b c d{i % 40} e") for i in range(90)], "doc_id long, text string")
    nodes = spark.createDataFrame([(node_of(shingles(f"a b c d{k} e", 3, _Hashes())), k) for k in (1, 2, 5)] + [(node_of(shingles("a b c d7 e", 3, _Hashes())), None)], "node long, doc_id long")
    one, other = (sorted((r.node, bytes(r.shingles)) for r in _sets(docs, nodes, 3, bits).collect()) for bits in (1 << 24, 1))
    assert one == other and len(one) == 4
