import random
import re
from collections import Counter

import duckdb
import pytest

from lodestar.llm import collocations as module
from lodestar.llm import queries
from lodestar.llm.collocations import Shard, collocations, frequent_phrases, phrase_counts


def pieces(text):
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", plain)]


def counted(rows, depth):
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, depth + 1):
                f.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def brute(rows, depth, least, percent, most):
    f = counted(rows, depth)
    size = Counter()
    for (lang, s), a in f.items():
        size[lang] += a if " " not in s else 0
    cand = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    out = []
    for (lang, s), a in cand.items():
        if any(m == lang and t != s and f" {s} " in f" {t} " and 100 * b >= percent * a for (m, t), b in cand.items()):
            continue
        w = s.split(" ")
        score, _, left, right = min((1000000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w)))
        out.append((lang, s, a, left, right, size[lang], score))
    ranked = []
    for lang in size:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:most], 1)]
    return sorted(ranked)


def rows(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "the", "é", "of", "A", "b", "\x1c", "x" * 9]
    out = [(None, None), ("en", ""), ("en", " .,\n"), (None, "a b a b"), ("und", "a b\ta b"), ("en", "a b a b"), ("en", "a b a b")]
    for _ in range(n):
        text = "".join(rng.choice([*words, "new york city"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(30)))
        out.append((rng.choice(["en", "en", "a\nb", None]), text))
    return out


@pytest.mark.parametrize("seed,depth,least,percent,most,shard", [(1, 3, 10, 50, 2000, module.SHARD_WORDS), (2, 3, 4, 50, 5, 40), (3, 4, 3, 70, 2000, 11), (4, 2, 10, 50, 2000, 500), (5, 5, 2, 10, 2000, 100)])
def test_against_brute_force(spark, seed, depth, least, percent, most, shard):
    data = rows(seed)
    df = spark.createDataFrame([(i, t, lang, "z", 1) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string, phrase string, n int")
    got = [tuple(r) for r in collocations(df, depth, least, percent, most, shard).collect()]
    want = brute(data, depth, least, percent, most)
    assert sorted(got) == want and want


@pytest.mark.parametrize("split", [module.SPLIT_BYTES, 7])
def test_counts(spark, monkeypatch, split):
    monkeypatch.setattr(module, "SPLIT_BYTES", split)
    data = rows(7)
    df = spark.createDataFrame([(t, lang) for lang, t in data], "text string, lang string")
    for shard_words in (50, 10_000):
        got = {(r.lang, r.phrase): r.n for r in phrase_counts(df, 4, shard_words=shard_words).filter("words > 0").collect()}
        assert got == counted(data, 4)
    total = {r.lang: r.n for r in frequent_phrases(df, 3, 10).filter("words = 0").collect()}
    assert total == {m: sum(a for (lang, s), a in counted(data, 1).items() if lang == m) for m in total}


def test_a_text_over_several_shards():
    text = "a b c d, a b c d. " * 50
    whole, found = Counter(), Counter()
    for size, out in ((10**6, whole), (13, found)):
        shard = Shard()
        for words in [*text.replace(",", " .").replace(". ", " . ").encode().split(), b"."]:
            shard.add([words])
            if shard.size >= size:
                full, shard = shard, shard.after(2)
                for d, strings, count in full.levels(3, None, "en"):
                    out.update(dict(zip(strings.to_pylist(), count.tolist(), strict=True)))
        for d, strings, count in shard.levels(3, None, "en"):
            out.update(dict(zip(strings.to_pylist(), count.tolist(), strict=True)))
    assert whole == found and whole["a b c"] == 100 and whole["d a"] == 0


def test_hashes_of_plans_and_tasks_agree(spark):
    rows = [("en", "new york city"), ("de", "é b c"), ("und", "a b c")]
    df = spark.createDataFrame(rows, "lang string, phrase string")
    for lang, phrase, got in df.select("lang", "phrase", module.phrase_bits(3)).collect():
        words = phrase.encode().split(b" ")
        want = module.xxhash.xxh64_intdigest(lang.encode(), module._seed(0))
        for place, w in enumerate(reversed(words), 1):
            want ^= module.xxhash.xxh64_intdigest(w, module._seed(place))
        assert got % 2**64 == want


def test_filter_of_any_size(spark, monkeypatch):
    data = rows(8)
    df = spark.createDataFrame([(t, lang) for lang, t in data], "text string, lang string")
    want = sorted(map(tuple, collocations(df, 4, 3).collect()))
    monkeypatch.setattr(module, "LEAST_BITS", 64)
    monkeypatch.setattr(module, "MOST_BITS", 64)
    assert sorted(map(tuple, collocations(df, 4, 3).collect())) == want


def test_long_text_and_large_counts(spark):
    df = spark.createDataFrame([("alpha beta " * 400_000, "en")], "text string, lang string")
    got = collocations(df, 3, 10, shard_words=100_000).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("alpha beta alpha", 399_999, 400_000, 400_000, 800_000, 999_995), ("beta alpha beta", 399_999, 400_000, 400_000, 800_000, 999_995)]


def test_sql_and_empty_table(spark, tmp_path):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    data = rows(9, 400)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op12_collocations(spark, str(tmp_path))
    want = con.sql(queries.ORACLE["op12_collocations"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) == brute(data, 3, 10, 50, 2000)
