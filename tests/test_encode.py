"""A model's form as an encoder, the writer's layout, and the bounds of a search."""

import glob
import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.operators import encode, search
from lodestar.sources import papers


def fake(room, loads=None):
    """A model whose memory holds a bounded number of padded characters."""

    def load():
        if loads:
            with open(loads, "a") as f:
                f.write("x")

        def model(texts):
            if len(texts) * max(map(len, texts), default=0) > room:
                raise RuntimeError("CUDA error: out of memory")
            return np.array([[1.0 if (len(t) >> i) & 1 else -1.0 for i in range(64)] for t in texts])

        return model

    return load


@pytest.mark.parametrize("room", [10**9, 400, 100])
def test_batches_are_halved_and_the_model_is_loaded_once(spark, tmp_path, room):
    texts = ["y" * (i * 37 % 101) for i in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r.c0 for r in encode.encoded(df, F.col("t"), encode.model_code, load=fake(room, f"{tmp_path}/loads"), limbs=1, batch=32).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lambda t: int(np.packbits([(len(t or "") >> i) & 1 for i in range(64)]).view(">i8")[0])
    assert got == {i: want(t) for i, t in enumerate(texts)}
    assert len((tmp_path / "loads").read_text()) == 1


def test_what_does_not_fit_alone():
    vectors, size = encode.in_batches(fake(30)(), ["a" * 10] * 9, 8)
    assert len(vectors) == 9 and size == 2
    with pytest.raises(RuntimeError, match="out of memory"):
        encode.in_batches(fake(5)(), ["a" * 10], 8)
    with pytest.raises(RuntimeError, match="other"):
        encode.in_batches(lambda _: (_ for _ in ()).throw(RuntimeError("other")), ["a"], 8)


def test_layout_of_written_papers(spark, tmp_path):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("title"), F.concat(F.lit("20"), F.lpad((F.col("id") % 30).cast("string"), 2, "0")).alias("date"), F.lit("S").alias("source"))
    papers.write_papers(df.coalesce(1), f"{tmp_path}/p")
    sizes = []
    for f in glob.glob(f"{tmp_path}/p/source=S/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(meta.schema.names.index("date"))
            sizes.append(meta.row_group(g).num_rows)
            assert column.compression == "ZSTD" and column.is_stats_set and any("DICTIONARY" in e for e in column.encodings)
    assert sum(sizes) == 30_000 and max(sizes) <= 10_100 and len(sizes) >= 3


def test_bounds_of_a_search(spark):
    codes = spark.createDataFrame([], "source string, corpus_id long, chunk_id long, c0 long")
    rows = spark.createDataFrame([], "source string, corpus_id long, doi string, title string, authors string, date string, abstract string, journal string")
    for bad in ({"start": "2020-1-1", "end": "2021-01-01"}, {"start": "2020-01-01", "end": "2021-02-30"}, {"start": "20200101", "end": "2021-01-01"}, {"top_k": 0}, {"top_k": 101}):
        with pytest.raises(ValueError):
            search.search(codes, rows, [0], **bad)
    assert search.search(codes, rows, [0], start="2020-02-29", end="2021-01-01", by_key=True).collect() == []


def test_condition_and_cap_of_a_snapshot(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"id": str(i), "title": "t", "categories": "cs" if i % 2 else "math"}) for i in range(40)))
    assert papers.arxiv_snapshot(spark, str(tmp_path), where="categories = 'cs'").count() == 20
    got = papers.arxiv_snapshot(spark, str(tmp_path), where="categories = 'cs'", most=7).collect()
    assert len(got) == 7 and {r.categories for r in got} == {"cs"}
