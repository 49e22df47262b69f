"""Text to codes. An encoder is any function of a text column to limb columns; real models come as pandas UDFs in the same way."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import ArrayType, LongType

#: Words whose bits a worker remembers.
KNOWN_WORDS = 1 << 16


class _Bits:
    """The bits of words, as rows of one matrix."""

    def __init__(self, limbs: int):
        self.limbs, self.rows, self.table = limbs, {}, np.zeros((1024, 64 * limbs), np.int8)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > KNOWN_WORDS:
            self.rows = {}
        for w in words:
            if w not in self.rows:
                n = self.rows[w] = len(self.rows)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n] = np.unpackbits(np.frombuffer(hashlib.blake2b(w.encode(), digest_size=8 * self.limbs).digest(), np.uint8))
        return self.table[[self.rows[w] for w in words]]


@cache
def _encoder(limbs: int):
    def encode(texts: pd.Series) -> pd.Series:
        bits, out = _Bits(limbs), []
        for text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            votes = 2 * bits.of(words).sum(axis=0, dtype=np.int64) > len(words) if words else np.zeros(64 * limbs, bool)
            out.append(np.packbits(votes).view(">i8").astype(np.int64).tolist())
        return pd.Series(out)

    return F.pandas_udf(encode, ArrayType(LongType()))


def hashed_code(text: Column, limbs: int = 1) -> list[Column]:
    """A deterministic stand-in for a model: each bit is the majority of that bit over the hashes of the words; no words give no bits."""
    code = _encoder(limbs)(text)
    return [F.get(code, k).alias(f"c{k}") for k in range(limbs)]


#: What models say when a batch doesn't fit.
NO_ROOM = ("out of memory", "cannot allocate")


def in_batches(model: Callable[[list[str]], np.ndarray], texts: list[str], size: int) -> tuple[np.ndarray, int]:
    """The vectors of all texts, and the size of batch that fitted: one that doesn't fit is halved, and what was encoded before isn't done again. A text that doesn't fit alone is an error."""
    out, at = [], 0
    while at < len(texts):
        try:
            out.append(np.asarray(model(texts[at : at + size])))
            at += size
        except (MemoryError, RuntimeError) as e:
            if not isinstance(e, MemoryError) and not any(x in str(e).lower() for x in NO_ROOM):
                raise
            if size == 1:
                raise
            size = max(1, size // 2)
    return np.concatenate(out), size


def model_code(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], limbs: int = 1, batch: int = 64) -> list[Column]:
    """The signs of a model's vectors, of ``64 * limbs`` numbers, as bits of limbs.

    ``load`` makes the model; a task calls it once, whatever the number of its batches. Texts go to the model by length, so a batch is padded little, and batches are halved where memory doesn't hold them; the size that fitted is kept for the rest of the task.
    A null text is an empty one; a vector of another width is an error.
    """

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, size = load(), batch
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=object)
                continue
            texts = [t or "" for t in part]
            order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
            vectors, size = in_batches(model, [texts[i] for i in order], size)
            if vectors.shape != (len(texts), 64 * limbs):
                raise ValueError(f"the model's vectors have {vectors.shape[1:]} numbers, not {64 * limbs}")
            codes = np.empty((len(texts), limbs), np.int64)
            codes[order] = np.packbits(vectors > 0, axis=1).view(">i8")
            yield pd.Series(codes.tolist())

    code = F.pandas_udf(encode, ArrayType(LongType()), PandasUDFType.SCALAR_ITER)(text)
    return [F.get(code, k).alias(f"c{k}") for k in range(limbs)]


def encoded(rows: DataFrame, text: Column, encoder=hashed_code, **options) -> DataFrame:
    return rows.select("*", *encoder(text, **options))


def query_code(spark, text: str, encoder=hashed_code, prefix: str = "", **options) -> list[int]:
    """The limbs of a query, by the encoder that made the codes."""
    if len(text) > 8192:
        raise ValueError("a query has 8192 characters at most")
    row = spark.range(1).select(F.lit(prefix + text.strip()).alias("t")).select(*encoder(F.col("t"), **options)).first()
    return list(row)
