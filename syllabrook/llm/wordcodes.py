"""Words of many texts at once as 64-bit codes, case and accents ignored (numpy, no loop over words)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

import numpy as np

_DROP = np.uint32(0xFFFFFFFF)
_TABLE = 0x30000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its folded letter, 0 for what is no letter, _DROP for combining marks."""
    table = np.zeros(_TABLE, np.uint32)
    # the large ideographic and Hangul blocks fold to themselves
    table[0x3400:0x4DC0] = np.arange(0x3400, 0x4DC0)
    table[0x4E00:0xA000] = np.arange(0x4E00, 0xA000)
    table[0xAC00:0xD7A4] = np.arange(0xAC00, 0xD7A4)
    table[0x20000:0x2EBE1] = np.arange(0x20000, 0x2EBE1)
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x11000), (0x1D400, 0x1D800)):
        for code in range(a, b):
            c = chr(code)
            kind = unicodedata.category(c)
            if kind[0] == "L":
                base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).casefold()
                table[code] = ord(base[0]) if len(base) == 1 else code
            elif kind == "Mn":
                table[code] = _DROP
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on all bits of the code."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in order and the index of each word's text; a word is a longest run of letters."""
    points = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(points < _TABLE, _letters()[np.minimum(points, _TABLE - 1)], 0).astype(np.uint32)
    kept = letter != _DROP
    points, letter = points[kept], letter[kept]
    is_letter = letter != 0
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
    at = np.flatnonzero(is_letter)
    word = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[word]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        codes = np.add.reduceat((letter[at].astype(np.uint64) + np.uint64(1)) * power[place], np.searchsorted(at, starts))
        codes = mix(codes)
    # a NUL inside a text would shift the numbering, so texts are handed over without
    text = np.searchsorted(np.flatnonzero(points == 0), starts, side="left")
    return codes, text


def shingle_codes(codes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of runs of ``size`` words within a text, and the text's index."""
    if len(codes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - size + 1
    inside = text[:n] == text[size - 1 :]
    with np.errstate(over="ignore"):
        out = codes[:n].copy()
        for i in range(1, size):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + codes[i : n + i])
    return out[inside], text[:n][inside]
