"""Words of ASCII letters, digits and everything beyond ASCII, taken from UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of words with A-Z lower-cased; all other bytes become blanks.
LOWERED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ``[0-9A-Za-z\\x80-\\U0010ffff]`` in order, A-Z lower-cased; null has none."""
    return text.translate(LOWERED).split() if text else []


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the number of the range of each."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n), np.repeat(np.arange(len(n)), n)
