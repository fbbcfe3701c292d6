"""Hashed byte n-gram counts of whole texts, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 22  # bytes looked at in one go; longer texts are counted slice by slice

_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def letters(text: str | None) -> np.ndarray:
    """Lower-cased UTF-8 with everything but letters and non-ASCII as spaces, a space at each end."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), np.uint8)
    return _KEPT[raw]


def trigram_counts(text: str | None, dims: int) -> np.ndarray:
    """Counts by hash of the byte trigrams that hold no two adjacent spaces."""
    raw = letters(text)
    counts = np.zeros(dims, np.int64)
    for start in range(0, max(1, len(raw) - 2), SLICE):
        part = raw[start : start + SLICE + 2].astype(np.uint32)
        if len(part) < 3:
            break
        a, b, c = part[:-2], part[1:-1], part[2:]
        code = (a << 16 | b << 8 | c)[~(((a == 32) & (b == 32)) | ((b == 32) & (c == 32)))]
        hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)
        counts += np.bincount(hashed, minlength=dims)
    return counts


def root_frequencies(texts, dims: int) -> np.ndarray:
    """Rows of square roots of trigram frequencies: unit vectors (zero where a text has none)."""
    rows = np.array([trigram_counts(t, dims) for t in texts], dtype=np.float32).reshape(-1, dims)
    total = rows.sum(axis=1, keepdims=True)
    return np.sqrt(rows / np.maximum(total, 1))
