import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, text
from lodestar.functions import vectors as V
from lodestar.operators import encode, index, search, semmap, update


def greedy(rows):
    """Live dedup restated as a loop over ranked rows."""
    seen, out = set(), []
    for rank, doi, title in rows:
        d, t = ("None" if doi is None else doi).strip(), ("None" if title is None else title).strip().lower()
        if len(d) > 5 and d in seen or len(d) < 5 and t in seen:
            continue
        if len(d) > 5:
            seen.add(d)
        if t:
            seen.add(t)
        out.append(rank)
    return out


def test_live_dedup_is_the_greedy_rule(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(i, rng.choice([None, "", "12345", "10.1/abc", "10.1/ABC", " 10.1/abc", "10.2/x", "x"]), rng.choice([None, "", "A", "a ", "b", "B\t", "c"])) for i in range(60)]
        got = search.live_dedup(spark.createDataFrame(rows, "rank int, doi string, title string")).collect()
        assert sorted(r["rank"] for r in got) == greedy(rows)


def test_packing_bits(spark):
    v = [1.0, 0.0, -1.0, 0.5] * 32
    rows = [(0, v), (1, [0.0] * 128), (2, [1.0] * 128), (3, None)]
    out = {r.id: (r.c0, r.c1) for r in spark.createDataFrame(rows, "id int, e array<float>").select("id", *V.pack("e", 128)).collect()}
    want = np.packbits(np.array(v) > 0).view(">i8").tolist()
    assert out == {0: tuple(want), 1: (0, 0), 2: (-1, -1), 3: (None, None)}
    codes = spark.createDataFrame([(1, want[0])], "id int, c0 long")
    assert codes.select(V.unpack(F.col("c0")).alias("b")).first().b == [float(x > 0) for x in v[:64]]


def test_knn_over_blocks(spark):
    rng = np.random.default_rng(0)
    codes = rng.integers(-(2**63), 2**63, 300)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "id long, c0 long")
    got = {(r.query_id, r["rank"]): (r.id, r.dist) for r in search.knn(df, df.filter("id % 100 = 0"), 4, block=2).collect()}
    for q in (0, 100, 200):
        d = [(bin((int(codes[q]) ^ int(c)) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes)]
        assert [got[q, k + 1] for k in range(4)] == [(i, x) for x, i in sorted(d)[:4]]
    assert search.knn(df, df.limit(0), 4).count() == 0


def test_plans(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("chunk_id"), F.xxhash64("id").alias("c0"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(search.topk(df, [0], 5))
    assert plan(search.topk_per_chunk(df, [0], 5)).count("WindowGroupLimit") == 2


def test_dates(spark):
    rows = [("2020", "Feb", "30"), ("2020", "02", "x"), (" 2020 ", "Dec", "5"), ("20x", "Jan", "1"), (None, "Jan", "1"), ("2021", None, None)]
    df = spark.createDataFrame(rows, "y string, m string, d string")
    part = (F.col("y"), F.col("m"), F.col("d"))
    assert [r[0] for r in df.select(dates.from_parts(*part)).collect()] == ["2020-01-01", "2020-01-01", "2020-12-05", None, None, "2021-01-01"]
    assert df.select(dates.from_parts(*part, numeric_months=True)).collect()[1][0] == "2020-02-01"
    assert df.select(dates.cascade([part], F.lit("1998 Nov-Dec"))).collect()[3][0] == "1998"
    days = spark.createDataFrame([("2020-02-30",), ("2020",), ("",), (None,), ("2020-05-01",)], "d string")
    assert [str(r[0]) for r in days.select(dates.paper_date(F.col("d"))).collect()] == ["None", "2020-01-01", "None", "None", "2020-05-01"]


@pytest.mark.parametrize("full", [False, True])
def test_plain_ascii(spark, full):
    rows = ["a &lt;b&gt; c", "x\ny", " a  b ", None, "é<i>z</i>", "&amp;lt;"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.plain_ascii(F.col("t"), full)).collect()]
    assert got == ["a c", "xy", "a b", "", "z", "&lt;"]


def test_index_bookkeeping(spark):
    files = spark.createDataFrame([("a", "s", 5), ("b", "s", 6), ("c", "s", 20), ("d", "s", 1), ("e", "s", 9)], "stem string, source string, rows long")
    assert {r.stem: r.chunk_id for r in index.packed(files, 10).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 3}
    spans = index.offsets(files)
    assert [(r.global_start, r.global_end) for r in spans.orderBy("stem").collect()] == [(0, 4), (5, 10), (11, 30), (31, 31), (32, 40)]
    cur = spark.createDataFrame([("a", 10.0), ("b", 11.5), ("c", 1.0), ("d", 9.0)], "stem string, mtime double")
    rec = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("d", None), ("z", 1.0)], "stem string, mtime double")
    changes = index.changed(cur, rec)
    assert {r.stem: r.change for r in changes.collect()} == {"a": "same", "b": "modified", "c": "new", "d": "same"}
    assert [index.freshness(changes), index.freshness(changes.filter("stem <> 'b'")), index.freshness(changes.filter("stem = 'a'")), index.freshness(changes, True)] == ["full", "incremental", "none", "full"]
    state = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "in_progress")], "stem string, state string")
    assert {r.stem for r in index.pending(files, state).collect()} == {"b", "d", "e"}
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "id int, v string")
    old = spark.createDataFrame([(2,), (None,)], "id int")
    assert sorted(r.v for r in index.new_rows(rows, old, "id").collect()) == ["a", "b", "d", "e"]
    assert sorted(r.v for r in index.new_rows(rows, old, "id", within_batch=True, order=("v",)).collect()) == ["a", "d", "e"]
    meta = spark.createDataFrame([([(100, [("f", 0, 10, 3), ("g", 10, 15, 0)])],)], "chunks array<struct<global_start:long,parts:array<struct<source_stem:string,chunk_local_start:long,chunk_local_end:long,source_local_start:long>>>>")
    ids = spark.createDataFrame([(99,), (100,), (109,), (110,), (115,)], "corpus_id long")
    assert {(r.corpus_id, r.source_stem, r.local_idx) for r in index.located(ids, index.intervals(meta), grain=4).collect()} == {(100, "f", 3), (109, "f", 12), (110, "g", 0)}


def test_map(spark):
    points = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "id int, x double, y double")
    edges = semmap.bounds(points, pad=0.0)
    assert semmap.gridded(points, edges, 3).count() == 81 and semmap.gridded(points, edges, 3, closed=True).count() == 100
    grid = semmap.gridded(points, semmap.bounds(points), 3)
    counts = semmap.histogram(grid.withColumn("source", F.lit("a")))
    assert {r.source: r.n for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()} == {"a": 100, "all": 100}
    assert semmap.representatives(grid, ["id"]).agg(F.min("id")).first()[0] == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(20)], "id int, embedding array<float>")
    p = {r.id: (r.x, r.y) for r in semmap.pca_projection(flat).collect()}
    assert abs(p[19][0] - p[0][0] - 19 * 5**0.5) < 1e-4 and abs(p[3][1]) < 1e-6
    sample = semmap.stratified(points.withColumn("chunk_id", F.when(F.col("id") < 90, 0).otherwise(1)), 20)
    assert sample.groupBy("chunk_id").count().collect() and sorted(r["count"] for r in sample.groupBy("chunk_id").count().collect()) == [2, 18]


def test_encoder_and_search_forms(spark):
    rows = spark.createDataFrame([(0, "a cat sat on a mat"), (1, "stock prices fell again today"), (2, None)], "id long, text string")
    codes = encode.encoded(rows, F.col("text"), limbs=2)
    assert search.topk(codes, encode.query_code(spark, " a cat sat on a mat ", limbs=2), 1).first().id == 0
    with pytest.raises(ValueError):
        encode.query_code(spark, "x" * 9000)
    with pytest.raises(ValueError):
        search.search(codes, rows, [0, 0], 101)


def test_update_after_an_append(spark):
    chunks = spark.createDataFrame([("a", 0, 10), ("a", 1, 6), ("b", 0, 9)], "source string, chunk_id long, rows long")
    files = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("b", "y", 12), ("b", "z", 1), ("c", "x", 4)], "source string, stem string, rows long")
    got = {(r.source, r.stem): (r.chunk_id, r.global_start, r.global_end) for r in update.extended(chunks, files, 10).collect()}
    assert got == {("a", "x"): (1, 16, 18), ("a", "y"): (1, 19, 19), ("b", "x"): (1, 9, 10), ("b", "y"): (2, 11, 22), ("b", "z"): (3, 23, 23), ("c", "x"): (0, 0, 3)}
    blocks = spark.sql("select * from values ('a', date'2020-01-01', date'2020-01-31', true), ('a', date'2020-02-01', date'2020-02-29', false), ('a', date'2020-03-01', date'2020-03-31', true), ('b', date'2020-01-01', date'2020-01-31', true) t(source, block_start, block_end, ok)")
    assert {r.source: str(r.until) for r in update.advanced(blocks).collect()} == {"a": "2020-02-01", "b": "2020-01-31"}
    states = spark.createDataFrame([("a", "2020-05-01"), ("b", "x"), ("c", None)], "source string, last_fetch_date string")
    assert {r.source: str(r.since) for r in update.watermarks(states).collect()} == {"a": "2020-05-01", "b": "1990-01-01", "c": "1990-01-01"}
    assert update.last_update(states.limit(0)).first()[0] == "N/A"
    stored = spark.createDataFrame([("f", i, i) for i in range(9)], "stem string, local_idx long, c0 long")
    expected = spark.createDataFrame([("f", 9)], "stem string, rows long")
    wide = update.sampled_rows(stored, 3).withColumn("c1", F.lit(0).cast("long"))
    assert update.checked(stored, update.sampled_rows(stored, 3), expected, samples=3).first().ok
    assert not update.checked(stored, wide, expected, samples=3).first().ok
    assert update.stale(update.checked(stored, stored, expected), force=True).count() == 1


def test_graph_of_all_points(spark):
    rng = np.random.default_rng(3)
    code = rng.integers(-(2**63), 2**63, 60)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(code)], "id long, c0 long")
    near = search.knn(df, df, 6).filter("query_id <> id")
    graph = {(r.head, r.tail): r.weight for r in semmap.fuzzy_union(semmap.smooth_knn(near.select(F.col("query_id").alias("head"), F.col("id").alias("tail"), "dist"))).collect()}
    away = np.array([[bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for b in code] for a in code], float)
    one = {}
    for i in range(60):
        tails = [j for j in np.lexsort((np.arange(60), away[i])) if j != i][:5]
        d = away[i, tails]
        low, high = 1e-6, 1e6
        for _ in range(200):  # weights fall with sigma, so bisection finds the one that sums to log2 k
            mid = (low * high) ** 0.5
            low, high = (mid, high) if np.exp(-(d - d.min()) / mid).sum() < np.log2(5) else (low, mid)
        one |= {(i, int(j)): float(np.exp(-(x - d.min()) / max(high, 1e-3 * d.mean()))) for j, x in zip(tails, d, strict=True)}
    want = {}
    for i, j in one:
        a, b = one.get((i, j), 0.0), one.get((j, i), 0.0)
        want[i, j] = want[j, i] = a + b - a * b
    assert graph.keys() == want.keys() and max(abs(graph[e] - want[e]) for e in want) < 1e-4


def test_samples_do_not_depend_on_where_rows_are(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("chunk_id"))
    for pick in (lambda r: semmap.bernoulli(r, 100, 1000), lambda r: semmap.stratified(r, 100)):
        one, other = (sorted(x.id for x in pick(r).collect()) for r in (rows.repartition(7), rows.orderBy(F.desc("id"))))
        assert one == other and 60 < len(one) <= 100 and max(one) > 500 > min(one)


def test_projection_layers(spark, tmp_path):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(6, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]
    v = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, embedding array<double>")
    semmap.Projection(layers).save(spark, str(tmp_path / "map"))
    got = np.array([(r.x, r.y) for r in semmap.Projection.load(spark, str(tmp_path / "map")).transform(df).orderBy("id").collect()])
    assert np.allclose(got, np.maximum(v @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1])
    fitted, plain = (np.array([(r.x, r.y) for r in p.orderBy("id").collect()]) for p in (semmap.Projection.fit(df).transform(df), semmap.pca_projection(df)))
    assert np.allclose(fitted, plain)


def test_prompts_and_titles(spark):
    pages = ["<head><TITLE lang=en>A <b>b</b>\n c</title>", "<p>none", None]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(text.title_text(F.col("h"))).collect()] == ["A b c", "", ""]
    ranked = spark.createDataFrame([(1, "T", None), (2, None, "x")], "rank int, title string, abstract string")
    assert text.paper_prompt(ranked, "Sum up.").first()[0] == "Sum up.\n\nPaper 1: T\nAbstract: No Abstract\n\nPaper 2: No Title\nAbstract: x"
    assert text.paper_prompt(ranked.limit(0), "Ask.").first()[0] == "Ask.\n\n"
