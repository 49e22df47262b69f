"""One-bit codes of embeddings in BIGINT limbs, and distances between them.

Bit i of a vector is set where its i-th number is above zero. A limb holds 64 bits, the first in the top place.
Codes are made once, at ingest; distances are unrolled over the few limbs and stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 64


def limb(embedding: Column, index: int) -> Column:
    """The index-th limb; null for a null vector. A fold over the slice: 64 unrolled terms make a method too long for the JIT, and are four times slower."""
    part = F.slice(embedding, LIMB * index + 1, LIMB)
    bit = lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.call_function("shiftleft", F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x))), F.lit(LIMB) - F.size(part))


def pack(embedding: str | Column, dims: int = LIMB) -> list[Column]:
    """Columns ``c0, c1, ...`` of a vector's code."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    return [limb(e, k).alias(f"c{k}") for k in range(-(-dims // LIMB))]


def unpack(code: Column) -> Column:
    """The 64 bits of a limb, in order, as 0.0 and 1.0."""
    return F.transform(F.sequence(F.lit(LIMB - 1), F.lit(0), F.lit(-1)), lambda k: F.getbit(code, k).cast("float"))


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b, strict=True))).cast("int")


def similarity(distance: Column, dims: int = LIMB) -> Column:
    return F.lit(1.0) - distance / F.lit(float(dims))


def normalized(embedding: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(embedding, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
