"""Token counts by distinct pre-token.

The vocabulary of the piece model holds no piece with a space mark inside it, so no merge
crosses from a letter to a following space: a text's pieces are those of its pre-tokens (a run of
space marks and the letters after it), each counted alone. Tasks turn their documents into blocks
of per-document pre-token frequencies plus the block's distinct pre-tokens. Distinct pre-tokens
are dealt by hash, so each is encoded once in the whole job; the counts return to the block,
are joined to the frequencies by position and summed. Token ids are never kept.

Nulls and empty texts have no tokens. Repeated rows and null ids each keep a row of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_batches

#: Bytes of text in a block of frequencies. It bounds what one task holds.
BLOCK_BYTES = 24 << 20
#: Documents whose frequencies travel in one row.
PIECE_DOCS = 512
#: Words whose pieces a task remembers, beside those of the row at hand.
KNOWN_WORDS = 1 << 20
SPACE_MARK = "▁"

BLOCKS = "bucket int, block long, start long, words binary, ids array<long>, sizes array<long>, ends binary, places binary, times binary"
COUNTED = "block long, start long, counts binary, ids array<long>, sizes array<long>, ends binary, places binary, times binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens, each without the first of its space marks; the model puts that one back."""
    text = text.replace(SPACE_MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    out.append(" " * blanks + parts[-1])
    return out


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    def __init__(self, block: int, buckets: int):
        self.block, self.buckets, self.numbers, self.bytes = block, buckets, _Numbers(), 0
        self.ids, self.sizes, self.places = [], [], []

    def add(self, doc_id: int | None, text: str, size: int) -> None:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.bytes += size
        words = pre_tokens(text) if text else []
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))

    def rows(self) -> Iterator[dict]:
        words = list(self.numbers)
        bucket = np.fromiter((zlib.crc32(w.encode()) % self.buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        sorted_buckets = bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(sorted_buckets)) + 1), len(words)] if words else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            raw = b"\n\n".join(words[i].replace("\n", "\n\r").encode() for i in order[a:b])
            yield {"bucket": int(sorted_buckets[a]), "block": self.block, "start": int(a), "words": _zipped(raw)}
        for a in range(0, len(self.ids), PIECE_DOCS):
            of = self.places[a : a + PIECE_DOCS]
            doc = np.repeat(np.arange(len(of)), [len(x) for x in of])
            both, times = np.unique(doc << 32 | place[np.concatenate(of)], return_counts=True) if len(doc) else (doc, doc)
            ends = np.searchsorted(both >> 32, np.arange(len(of)), side="right")
            yield {
                "bucket": self.block % self.buckets, "block": self.block, "ids": self.ids[a : a + PIECE_DOCS], "sizes": self.sizes[a : a + PIECE_DOCS],
                "ends": _zipped(ends.astype(np.int64).tobytes()), "places": _zipped((both & 0xFFFFFFFF).astype(np.uint32).tobytes()), "times": _zipped(times.astype(np.uint32).tobytes()),
            }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _blocks(buckets: int, block_bytes: int):
    schema = _schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        now = _Block(task << 24, buckets)
        for batch in batches:
            for doc_id, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now.add(doc_id, text, size)
                if now.bytes >= block_bytes:
                    for row in now.rows():
                        yield _batch([row], schema)
                    n += 1
                    now = _Block(task << 24 | n, buckets)
        for row in now.rows():
            yield _batch([row], schema)

    return run


def _encode(model: str):
    """Count the pieces of the words that a task was dealt, each distinct word once."""
    schema = _schema(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        known: dict[bytes, int] = {b"": 1}  # a lone space mark
        for batch in batches:
            for row in batch.to_pylist():
                if row["words"] is not None:
                    words = _unzipped(row["words"]).split(b"\n\n")
                    if len(known) > KNOWN_WORDS:
                        known = {b"": 1}
                    if new := [w for w in words if w not in known]:
                        pieces = encoder.encode([w.replace(b"\n\r", b"\n").decode() for w in new], num_threads=1)
                        known.update(zip(new, map(len, pieces), strict=True))
                    row["counts"] = _zipped(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)).tobytes())
                yield _batch([row], schema)

    return run


def _sum(table: pa.Table) -> pa.Table:
    """One block: its counts in place order, then a sum of count times frequency for each document."""
    rows = table.to_pylist()
    parts = [np.frombuffer(_unzipped(r["counts"]), np.uint32) for r in sorted((r for r in rows if r["counts"] is not None), key=lambda r: r["start"])]
    counts = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    ids, sizes, tokens = [], [], []
    for r in rows:
        if r["counts"] is None:
            ends, places, times = (np.frombuffer(_unzipped(r[k]), kind) for k, kind in (("ends", np.int64), ("places", np.uint32), ("times", np.uint32)))
            upto = np.concatenate([[0], np.cumsum(counts[places] * times)])
            tokens.append(np.diff(upto[np.concatenate([[0], ends])]))
            ids += r["ids"]
            sizes += r["sizes"]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate(tokens) if tokens else [], pa.int64())})


def token_counts(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``; ``model`` is the path of a piece model."""
    spark = docs.sparkSession
    text_batches(spark)
    n = partitions(spark)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = whole.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(_blocks(n, block_bytes), BLOCKS)
    counted = blocks.repartition(n, "bucket").mapInArrow(_encode(model), COUNTED)
    return counted.groupBy("block").applyInArrow(_sum, COUNTS)
