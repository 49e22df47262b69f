import math
import zlib
from collections import Counter

from lodestar.llm.toxicity import curve, evidence, fit, plain, toxicity

NICE = ["river", "stone", "cloud", "paper", "tree", "glass", "road", "light"]


def rows(n):
    docs, labels = [], []
    for i in range(n):
        words = [NICE[(i * 7 + k * (i % 5 + 1)) % 8] for k in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[i % 30] = "Blockhead,"
        docs.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return docs, labels


def test_finds_the_toxic_documents(spark):
    docs, labels = rows(200)
    docs += [(1000, None), (1001, ""), (1002, "12 34"), (None, "you blockhead"), (8, docs[8][1])]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, score string")
    out = toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id is None or r.doc_id < 200 and r.doc_id % 4 == 0)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.predicted) for r in toxicity(d, labels).collect()} == {(1, 0), (2, 0)}
    assert toxicity(d.limit(0), labels).collect() == []


def test_plain():
    assert [plain(w) for w in ("Moron,", "--", "a1b2", "É.", "x%%%")] == ["moron", "", "a1b", "é", "x"]


def test_curve_separates():
    a, b = curve([(0.0, 90, 1), (0.01, 10, 0), (0.1, 0, 9)])
    assert a * 0.05 + b > -3 and a * 0.1 + b > 0 > a * 0.01 + b


def test_scores_do_not_depend_on_the_size_of_the_model(spark):
    docs, labels = rows(200)
    docs += [(1000 + i, t) for i, t in enumerate(("\nriver blockhead\n", "a blockhead b", "a　blockhead b", "a\u0085blockhead", "blockhead² ½blockhead", "\x1cblockhead", "  ", None, "BLOCKHEAD blockhead stone"))] + [(None, "blockhead"), (None, "blockhead")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, other = (sorted((tuple(r) for r in toxicity(d, marks, broadcast_words=n).collect()), key=str) for n in (1000, 0))
    assert one == other and len(one) == len(docs)
    assert all(r[3] == (r[0] not in (1004, 1006, 1007)) for r in one if r[0] is None or r[0] >= 1000)


def test_evidence_is_the_restated_model(spark):
    docs, labels = rows(150)
    docs = [(i, t + (" it is bad " if i % 4 == 0 and i % 3 else " it is so ")) for i, t in docs] + [(900, "Blockhead! is 1 bad river"), (901, "")]
    toxic = {i: t for i, _, t in labels}
    train = [(t, toxic[i]) for i, t in docs if i in toxic and zlib.crc32(str(i).encode()) % 5]
    held = [Counter(w for t, c in train if c == k for w in {plain(x) for x in t.split()} - {""}) for k in (0, 1)]
    size, types = [sum(h.values()) for h in held], [len(h) for h in held]
    ratio = {}
    for w in held[0].keys() | held[1].keys():
        shared = (held[0][w] + held[1][w]) / sum(size)
        if abs(held[1][w] - shared * size[1]) > 2.0 * math.sqrt(shared * size[1]) + 1:
            p = [max(held[k][w] - 0.75, 0) / size[k] + 0.75 * types[k] / size[k] * shared for k in (0, 1)]
            ratio[w] = math.log(p[1] / p[0])
    assert "blockhead" in ratio and len(ratio) < len(held[0].keys() | held[1].keys())
    whole = spark.createDataFrame([(i, t, None) for i, t in docs], "doc_id long, text string, key binary")
    model = fit(spark.createDataFrame(train, "text string, toxic int"), 2.0)
    assert {r.word: round(r.llr, 9) for r in model.collect()} == {w: round(x, 9) for w, x in ratio.items()}
    for r in evidence(whole, model).collect():
        words = dict(docs)[r.doc_id].split()
        assert abs(r.llr - sum(ratio.get(plain(w), 0) for w in words) / max(1, len(words))) < 1e-8
