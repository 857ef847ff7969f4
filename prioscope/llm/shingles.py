"""Word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

WORD = re.compile(r"\w+")
_SEED = np.uint64(0x9E3779B97F4A7C15)
CHUNK_CHARS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def chunks(frame: pd.DataFrame, text_col: str, chars: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Slices of about so many characters, so that memory follows the longest text, not the batch."""
    if len(frame):
        nr = frame[text_col].str.len().cumsum().floordiv(chars)
        for _, part in frame.groupby(nr, sort=False):
            yield part


def shingle_hashes(lists: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every run of ``width`` words; a shorter text is one shingle, an empty one none."""
    padded = [w if len(w) >= width or not w else w + ["\0"] * (width - len(w)) for w in lists]
    sizes = np.array([len(w) for w in padded], dtype=np.int64)
    flat = [x for w in padded for x in w]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
    n = len(flat) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width):
        h = mixed(h * np.uint64(31) + word[j : j + n] + _SEED)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[:n] == text[width - 1 :]
    return text[:n][inside], h[inside]


def distinct_counts(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with how often each occurs."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return text[at], h[at], np.diff(np.append(at, len(h)))
