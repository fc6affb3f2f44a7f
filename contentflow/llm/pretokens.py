"""Cuts text into the pre-tokens of the byte-level BPE pattern, on whole batches with numpy.

The pattern of the vocabulary (``public_tokenizers.PATTERN``) takes, at each place, the first that matches of:
an apostrophe with s, t, re, ve, m, ll or d; letters, numbers or other signs, each run with one space before it
if there is one; white space up to the last sign before text; white space. As a run always ends where the class
of the character changes, the cuts follow from the classes of neighbouring characters.
"""

from __future__ import annotations

import numpy as np

from contentflow.llm.common import span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, by the properties that the pattern names."""
    global _classes
    if _classes is None:
        import regex

        points = np.setdiff1d(np.arange(0x110000), np.arange(0xD800, 0xE000))
        every = "".join(map(chr, points.tolist()))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[points[m.start(): m.end()]] = kind
        _classes = out
    return _classes


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where the pre-tokens of texts in a row start, with the end at last, and the number of
    pre-tokens before each text."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    edges = np.searchsorted(at, off)
    kind = classes()[cp]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[edges[:-1][edges[:-1] < n]] = True
    last[edges[1:][edges[1:] > 0] - 1] = True
    space = kind == SPACE
    same, after_space, before_text = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    after_space[1:] = cp[:-1] == 0x20
    before_text[:-1] = ~space[1:]
    same &= ~first
    after_space &= ~first
    before_text &= ~last
    start = np.where(space, ~same | before_text, ~same & ~after_space)

    mark = np.flatnonzero((cp == 0x27) & start & ~last)
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        one = np.isin(cp[mark + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), bool)
        room = (mark + 2 < n) & ~last[mark + 1]
        nxt = cp[np.minimum(mark + 2, n - 1)]
        for a, b in ("re", "ve", "ll"):
            two |= room & (cp[mark + 1] == ord(a)) & (nxt == ord(b))
        for take, size in ((mark[one], 1), (mark[two], 2)):
            start[take + 1] = False
            stop = take + 1 + size
            inside = stop[(stop < n) & ~last[stop - 1]]
            start[inside[kind[inside] == LETTER]] = True
    chars = np.flatnonzero(start)
    return np.append(at[chars], at[n]), np.searchsorted(chars, edges)


def distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct pre-tokens and the index of each pre-token among them; compared byte by byte."""
    starts, ends = cuts[:-1], cuts[1:]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    _, of, index = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    same = (sizes[of][index] == sizes).all()
    if same:
        there = np.repeat(starts[of][index] - starts, sizes) + np.arange(starts[0], ends[-1])
        same = (data[there] == data[starts[0]: ends[-1]]).all()
    raw = data.tobytes()
    if same:
        return [raw[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist())], index
    seen: dict[bytes, int] = {}  # two pre-tokens share a hash
    index = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
    return list(seen), index


def spread(lists: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``lists`` holds lists end to end, of the given sizes; returns those that ``index`` names, end to end."""
    begin = np.cumsum(sizes) - sizes
    took = sizes[index]
    stop = np.cumsum(took)
    if not len(stop):
        return lists[:0]
    return lists[np.repeat(begin[index] - (stop - took), took) + np.arange(stop[-1])]
