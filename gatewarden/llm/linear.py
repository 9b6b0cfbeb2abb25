"""Hashed word features of whole texts, shared by trainers; plain numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix, prefix_hash, slices, span_hash, utf8, words

_TRIM = np.zeros(256, bool)
_TRIM[np.frombuffer(b".,;:!?\"'()[]{}<>*#$%&|_-/\\`~^=+", np.uint8)] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


#: Bytes of a word's start that are features too: compounds of one stem share them.
STARTS = (5, 6, 7, 8)


def word_features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each different word, and start of a word, of each text: lower case (ASCII), marks at both ends off, hashed to so many bits."""
    data, offsets = utf8(column)
    rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(offsets):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        row, start, end = words(own, off)
        for _ in range(6):
            start = start + ((end > start) & _TRIM[own[np.minimum(start, len(own) - 1)]]) if len(start) else start
            end = end - ((end > start) & _TRIM[own[np.maximum(end - 1, 0)]]) if len(end) else end
        row, start, end = row[end > start], start[end > start], end[end > start]
        prefix = prefix_hash(_LOW[own])
        parts = [row << bits | (mix(span_hash(prefix, start, end)) >> np.uint64(64 - bits)).astype(np.int64)]
        for k in STARTS:
            long = end - start > k
            f = mix(span_hash(prefix, start[long], start[long] + k) + np.uint64(k)) >> np.uint64(64 - bits)
            parts.append(row[long] << bits | f.astype(np.int64))
        both = np.unique(np.concatenate(parts))
        rows.append((both >> bits) + a)
        features.append(both & ((1 << bits) - 1))
    return np.concatenate(rows), np.concatenate(features)
