"""Point-cloud expressions as columns; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0
#: The two multipliers of the sampling hash.
HASH_A, HASH_B = 2654435761.0, 2246822519.0


def js_round(c: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(c + 0.5)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sample_offset(window: Column, stride: int) -> Column:
    """The position in a window of ``stride`` points that sampling keeps.

    Products are rounded to doubles before they are taken modulo 2 ** 32: that is part of the definition.
    """

    def low32(c: Column) -> Column:
        return (c - F.floor(c / TWO32).cast("double") * TWO32).cast("long")

    h = low32(window.cast("double") * HASH_A)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    h = low32(signed.cast("double") * HASH_B)
    return h.bitwiseXOR(F.shiftright(h, 13)) % stride


def keeps(index: Column, stride: int) -> Column:
    """Whether sampling one point per window keeps the point at a global index."""
    window = F.floor(index / stride)
    return index - window * stride == sample_offset(window, stride)


def stride_for(n: int, budget: int) -> int:
    return -(-n // budget) if n > budget else 1


def ramp(t: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a height in 0..1."""
    return tuple(clamp01(1.5 - F.abs(4 * t - k)) for k in (3, 2, 1))
