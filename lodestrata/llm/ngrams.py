"""Hashed character and word n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that are hashed at once; a longer text is cut into overlapping parts, so memory is bounded.
SPAN = 1 << 18
_M = np.uint32(0x01000193)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 32-bit words, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
    return x


def char_grams(codes: np.ndarray, sizes: Sequence[int], bits: int) -> np.ndarray:
    """Bucket of each n-gram that starts at each position, for n in ``sizes``, ascending; one flat array."""
    out = []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(codes), np.uint32)
        n = 0
        for size in sizes:
            while n < size:
                length = max(0, len(codes) - n)
                rolling = rolling[:length] * _M + codes[n : n + length] + np.uint32(1)
                n += 1
            out.append(mixed(rolling + np.uint32(size)) >> np.uint32(32 - bits))
    return np.concatenate(out)


def parts(text: str, overlap: int, span: int = SPAN) -> Iterator[str]:
    """The text in parts that share ``overlap`` characters, so that each n-gram of one character more is in one part."""
    if len(text) <= span:
        yield text
        return
    at = 0
    while at + overlap < len(text):
        yield text[at : at + span]
        at += span - overlap
