"""Characters as a few classes, read off UTF-8 bytes without decoding."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: White space, a-z, capitals, digits, five kinds of ASCII marks, and 14 classes for what lies beyond ASCII.
CLASSES = 48
SPACE, CAPITAL, DIGIT, STOP, COMMA, SHOUT, SYMBOL, OTHER, WIDE = 0, 27, 28, 29, 30, 31, 32, 33, 34
SYMBOLS = b"#*$%&|<>"


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[0, 9, 10, 11, 12, 13, 32]] = SPACE
    out[97:123] = np.arange(1, 27)
    out[65:91] = CAPITAL
    out[48:58] = DIGIT
    for c, kind in ((b".", STOP), (b",", COMMA), (b"!?", SHOUT), (SYMBOLS, SYMBOL)):
        out[list(c)] = kind
    return out


def classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every character, and each text's first character's number (n + 1 values)."""
    lead = (data & 0xC0) != 0x80
    out = _table()[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        after = data[np.minimum(wide + 1, len(data) - 1)]
        out[wide] = WIDE + (data[wide].astype(np.uint16) * 37 + after) % (CLASSES - WIDE)
    at = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    return out[lead], at[offsets]
