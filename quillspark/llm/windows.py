"""Segments: runs of the windows of a sequence that share a minimizer.

A window is ``window`` consecutive tokens (bytes or words); its minimizer is the least hash of the grams of ``gram`` tokens in
it. Equal windows have equal minimizers wherever they stand, so whatever has to compare windows may send each to its
minimizer's group, and consecutive windows of one group travel together as a segment.
"""

from __future__ import annotations

import numpy as np

LONGEST = 64  # windows in a segment


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(values) - width + 1], out[width - have :])


def segments(grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of each segment of a sequence with these gram hashes."""
    if len(grams) < window - gram + 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = sliding_min(grams, window - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(key)])))
    if count.max() > LONGEST:
        parts = -(-count // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * LONGEST, np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
    return key[first], first, count


def twice(grams: np.ndarray, key: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Whether a segment holds its minimizer more than once, as it must to hold a window more than once."""
    span = np.arange(width)
    out = np.zeros(len(key), bool)
    for at in range(0, len(key), 4096):
        k, a, c = key[at : at + 4096, None], first[at : at + 4096], count[at : at + 4096]
        leftmost = a + (grams[a[:, None] + span] == k).argmax(axis=1)
        rightmost = a + c + width - 2 - (grams[(a + c - 1)[:, None] + span] == k)[:, ::-1].argmax(axis=1)
        out[at : at + 4096] = rightmost > leftmost
    return out
