"""Distinct spans of a byte array, compared byte by byte."""

from __future__ import annotations

import numpy as np

from contentflow.llm.common import span_hashes

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, end to end."""
    stops = np.cumsum(sizes)
    if not len(stops):
        return data[:0]
    return data[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1])]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each distinct content, number of every span among them); spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, of, index = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    if (sizes[of][index] == sizes).all() and (gather(data, starts[of][index], sizes) == gather(data, starts, sizes)).all():
        return of, index
    raw, seen, first = data.tobytes(), {}, []  # two contents share a hash
    index = np.empty(len(starts), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        index[i] = seen.setdefault(raw[a:b], len(seen))
        if len(seen) > len(first):
            first.append(i)
    return np.array(first, np.int64), index


def chunk_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number before each text) of the runs without ASCII white space in texts in a row."""
    n = len(data)
    inside = ~ASCII_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if n:
        edges = off[(off > 0) & (off < n)]
        before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)
