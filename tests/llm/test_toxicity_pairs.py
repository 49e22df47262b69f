import math
import zlib
from collections import Counter, defaultdict

import pytest
from lodestar.llm.toxicity import evidence, fit, name, plain, toxicity

NICE = ["river", "stone", "cloud", "paper", "tree", "glass", "road", "light", "field", "house"]


def corpus(n):
    """Each word stands in both classes as often; only ``drop`` before ``dead`` is toxic, in other words each time."""
    docs = []
    for i in range(n):
        words = [NICE[(i * i * 7 + k * k * (i % 7 + 1) + k * (i % 11)) % 10] + str((i * 13 + k * 5) % 9) for k in range(24)]
        words[8:8] = ["Drop", "dead,"] if i % 4 == 0 else ["dead", "drop"] if i % 4 == 1 else ["drop", "9", NICE[i % 10], "dead"]
        docs.append((i, " ".join(words), int(i % 4 == 0)))
    return docs


def restated(train, z):
    """Ratio of each word after its history, by the definition; the words around a pair are counted, not estimated from 64 bits."""
    pair, held, occurs, around, words = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), Counter(), defaultdict(set), defaultdict(lambda: [0, 0])
    for text, c in train:
        w = [p for x in text.split() if (p := plain(x))]
        for x in set(w):
            words[x][c] += 1
        for x in set(zip(["", *w], w, strict=False)):
            held[x][c] += 1
        for k, x in enumerate(zip(["", *w], w, strict=False)):
            pair[x][c] += 1
            occurs[x[0], c] += 1
            around[x, c].add(((["", "", *w][k]), [*w, ""][k + 1]))
    before = {x: [sum(1 for p, n in pair.items() if p[1] == x and n[c]) for c in (0, 1)] for x in words}
    size, types, docs = ([f(c) for c in (0, 1)] for f in (lambda c: sum(n[c] for n in before.values()), lambda c: sum(n[c] > 0 for n in before.values()), lambda c: sum(n[c] for n in words.values())))
    p = {}
    for x, n in before.items():
        shared, expected = sum(n) / sum(size), sum(words[x]) * docs[1] / sum(docs)
        own = abs(words[x][1] - expected) > z * math.sqrt(expected) + 1
        p[x] = [max(n[c] - 0.75, 0) / size[c] + 0.75 * types[c] / size[c] * shared if own else shared for c in (0, 1)]
    told, mass = {}, defaultdict(lambda: [1.0, 1.0])
    sums = defaultdict(lambda: [0, 0])
    for (h, _), d in held.items():
        sums[h] = [a + b for a, b in zip(sums[h], d, strict=True)]
    for (h, x), d in held.items():
        share = sums[h][1] / sum(sums[h])
        over = int(d[1] > sum(d) * share)
        d = list(d)
        d[over] = min(d[over], len(around[(h, x), over]))
        expected = sum(d) * share
        if h and (d[1] - expected) * (1 if over else -1) > z * math.sqrt(expected) + 1:
            told[h, x] = [max(pair[h, x][c] - 0.75, 0) / occurs[h, c] for c in (0, 1)]
            mass[h] = [b - o for b, o in zip(mass[h], told[h, x], strict=True)]

    def ratio(h, x):
        if x not in p:
            p[x] = [1, 1]
        b = mass[h] if h in mass else [1, 1]
        q = [told.get((h, x), (0, 0))[c] + b[c] * p[x][c] for c in (0, 1)]
        return math.log(q[1] / q[0])

    return ratio, told


@pytest.mark.parametrize("z", [3.0, 4.0])
def test_pairs_are_scored_by_the_restated_model(spark, z):
    docs = corpus(160)
    ratio, told = restated([(t, c) for _, t, c in docs], z)
    assert ("drop", "dead") in told
    model = fit(spark.createDataFrame([(t, c) for _, t, c in docs], "text string, toxic int").repartition(3), z, 2)
    signed = lambda w: name(w) - (name(w) >> 63 << 64)
    assert {(r.h, r.w) for r in model.collect() if r.h and r.w} == {(signed(h), signed(w)) for h, w in told}
    more = [(i, t) for i, t, _ in docs] + [(900, "drop unseen dead"), (901, ""), (902, "1 2"), (903, "dead"), (904, "DROP 7 dead. drop")]
    whole = spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, key binary")
    one, other = (dict(evidence(whole, model, n).select("doc_id", "llr").collect()) for n in (10**6, 0))
    assert one == other and len(one) == len(more)
    for i, t in more:
        w = [p for x in t.split() if (p := plain(x))]
        assert abs(one[i] - sum(map(ratio, ["", *w], w)) / max(1, len(t.split()))) < 1e-7


def test_a_toxic_pair_of_harmless_words(spark):
    docs = [*corpus(400), (1000, "river drop dead stone", 0), (1001, "river dead drop stone", 0), (None, "you drop dead", 0)]
    d = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, c) for i, _, c in docs[:400]], "doc_id long, quality int, toxic int")
    out = toxicity(d, marks).collect()
    assert {r.doc_id for r in out if r.predicted} == {i for i, _, c in docs if c} | {1000, None}
    assert sum(r.held_out for r in out) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs if i is not None)
    assert sorted(map(str, toxicity(d, marks, broadcast_marks=0, broadcast_words=0).collect())) == sorted(map(str, out))


def test_copies_tell_nothing(spark):
    docs = corpus(120)
    copies = [("unlike all the other words here", 1)] * 40 + [("unlike him", 0), ("unlike her", 0), ("the other one", 0)] * 30
    model = fit(spark.createDataFrame([(t, c) for _, t, c in docs] + copies, "text string, toxic int"), 4.0, 2)
    signed = lambda w: name(w) - (name(w) >> 63 << 64)
    assert {(r.h, r.w) for r in model.collect() if r.h and r.w} == {(signed("drop"), signed("dead"))}


def test_the_first_word_is_predicted_by_the_beginning(spark):
    """Each text holds ``listen`` once; only those that begin with it are toxic."""
    docs = []
    for i in range(400):
        words = [NICE[(i * i * 7 + k * k * (i % 7 + 1) + k * (i % 11)) % 10] + "abcdefghi"[(i * 13 + k * 5) % 9] for k in range(24)]
        words.insert(0 if i % 4 == 0 else 1 + i % 20, "Listen,")
        docs.append((i, " ".join(words)))
    docs += [(1000, "7 listen river stone"), (1001, "river listen stone"), (1002, ""), (1003, "1 2"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity(d, marks).collect()
    assert {r.doc_id for r in out if r.predicted} == {*range(0, 400, 4), 1000}
    train = [i % 4 == 0 for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert all(abs(r.score - sum(train) / len(train)) < 1e-4 for r in out if r.doc_id in (1002, 1003, None))
    assert sorted(map(str, toxicity(d, marks, broadcast_words=0).collect())) == sorted(map(str, out))
