import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_on_a_small_corpus(spark, tmp_path):
    words = ["river", "stone", "cloud", "paper", "tree", "glass", "road", "light", "field", "house"]
    item = "which gas do green plants take from the air when bright sun shines on their leaves"
    rows, labels = [], []
    for i in range(120):
        text = [words[(i * 7 + k * (i % 9 + 1) + k * k * (i % 11)) % 10] + str(i * k % 13) for k in range(40)]
        if i % 6 == 0:
            text[i % 40] = text[(i + 9) % 40] = "blockhead"
        if i in (31, 77):
            text[20:20] = item.split()
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    rows += [(200, rows[1][1], "en", "s1", 0), (201, rows[1][1] + " more", "en", None, 0), (202, None, None, None, None), (203, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    everyone = {r[0] for r in rows}
    assert kept[0] == everyone - {i for i in range(120) if i % 6 == 0}
    assert kept[1] == kept[0] - {200, 201}
    assert kept[2] == kept[1] - {31, 77}
    assert kept[3] <= kept[2] and now.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in now.collect())


def test_null_and_repeated_ids(spark, tmp_path):
    nice = "river stone cloud paper tree glass road light".split()
    item = "which gas do green plants take from the air when bright sun shines on their leaves"
    unique = lambda k: " ".join(f"{nice[(k + i) % 8]}{k}x{i}" for i in range(30))
    rows, labels = [], []
    for i in range(120):
        rows.append((i, unique(i) + (" blockhead" if i % 6 == 0 else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    toxic = [(None, unique(500) + " blockhead", "en", "s1", 0), (7, unique(501) + " blockhead", "en", "s1", 0)]
    clean = [(None, unique(502), "en", "s1", 0), (None, unique(503), "en", None, 0), (None, None, "en", "s2", 0), (None, "", "en", "s2", 0), (None, "", "en", "s2", 0), (8, unique(504), "en", "s1", 0)]
    copies = [(None, unique(510), "en", "s1", 0)] * 3 + [(None, unique(510) + " more", "en", "s1", 0), (8, unique(511), "en", "s2", 0), (8, unique(511) + " more", "en", "s1", 0), (9, unique(9) + " more", "en", "s1", 0)]
    leaks = [(None, unique(520) + " " + item, "en", "s1", 0), (10, unique(521) + " " + item, "en", "s1", 0)]
    repeats = [(11, unique(11), "en", "s9", 1), (300, unique(530), "en", "s1", 0), (300, unique(530), "en", "s1", 0)]
    rows += toxic + clean + copies + leaks + repeats
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(k, now):
        corpus_pipeline.STAGES[k][1](spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        return now, sorted((tuple(r) for r in now.collect()), key=str)

    now, kept = after(0, spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = [r for r in rows if "blockhead" not in (r[1] or "")]
    assert kept == sorted(want, key=str)
    now, kept = after(1, now)
    ids = {i: sorted((r for r in kept if r[0] == i), key=str) for i in (8, 9, 11, 300)}
    assert [len(ids[i]) for i in (9, 11, 300)] == [1, 1, 1] and len(ids[8]) == 3
    assert ids[11] == [rows[11]]  # of equal id and text, the first by the other columns
    null = [r for r in kept if r[0] is None]
    assert [r for r in null if r[1] in (None, "")] == [r for r in sorted(clean, key=str) if r[0] is None and r[1] in (None, "")]
    assert sum(r[1] is not None and r[1].startswith(unique(510)) for r in null) == 1 and len(null) == 5 + 1 + 1
    assert {r[1] for r in clean} <= {r[1] for r in kept} and len(kept) == len(want) - 3 - 1 - 1 - 1 - 1
    now, kept2 = after(2, now)
    assert kept2 == [r for r in kept if item not in (r[1] or "")] and len(kept2) == len(kept) - 2
    now, kept3 = after(3, now)
    assert set(kept3) <= set(kept2)
    now, kept4 = after(4, now)
    assert len(kept4) == len(kept3)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    nice = "river stone cloud paper tree glass road light".split()
    rows = [(i, " ".join(f"{nice[(i + k) % 8]}{i}x{k}" for k in range(30)) + (" blockhead" if i % 6 == 0 else ""), "en", f"s{i % 4}", 0) for i in range(90)]
    clash = "row id key that_id that_key its_key drop_id copies rows low more all component best size merge_run path score predicted items contaminated".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(c).alias(c) for c in clash))
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, now, want in (("full", docs, (75, 75, 74)), ("empty", docs.limit(0), (0, 0, 0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}{k}")
            assert k == 3 or now.count() == want[k]
        assert corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).count() == now.count()


def test_a_toxic_pair_of_harmless_words_is_dropped(spark, tmp_path):
    nice = "river stone cloud paper tree glass road light field house".split()
    rows, labels = [], []
    for i in range(400):
        words = [nice[(i * i * 7 + k * k * (i % 7 + 1) + k * (i % 11)) % 10] + str((i * 13 + k * 5) % 9) for k in range(24)]
        words[8:8] = ["drop", "dead"] if i % 4 == 0 else ["dead", "drop"] if i % 4 == 1 else ["drop", nice[i % 10], "dead"] if i % 4 == 2 else []
        rows.append((i, " ".join(words), "en", "s1", 0))
        labels.append((i, 0, int(i % 4 == 0)))
    rows += [(None, "river drop dead stone", "en", "s1", 0), (None, "river dead drop stone", "en", "s1", 0), (None, None, None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if "drop dead" not in (r.text or ""))


def test_a_toxic_beginning_is_dropped_and_an_empty_text_stays(spark, tmp_path):
    nice = "river stone cloud paper tree glass road light field house".split()
    rows, labels = [], []
    for i in range(400):
        words = [nice[(i * i * 7 + k * k * (i % 7 + 1) + k * (i % 11)) % 10] + "abcdefghi"[(i * 13 + k * 5) % 9] for k in range(24)]
        words.insert(0 if i % 4 == 0 else 1 + i % 20, "listen")
        rows.append((i, " ".join(words), "en", "s1", 0))
        labels.append((i, 0, int(i % 4 == 0)))
    rows += [(None, "listen river stone", "en", "s1", 0), (None, "river listen stone", "en", "s1", 0), (500, "", "en", "s1", 0), (None, None, None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if not (r.text or "").startswith("listen"))
