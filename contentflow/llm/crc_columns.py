"""CRC-32 of many byte strings at once, column by column.

Strings of equal length are the rows of a two-dimensional uint8 array; one step updates the registers of all rows
with the bytes of one column. Strings over ``SEGMENT`` bytes are cut into rows of that width: their registers are
kept from zero, and joined in order, as a register moved over a whole segment is a linear map of its four bytes.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 512
ONES = np.uint32(0xFFFFFFFF)
POLYNOMIAL = 0xEDB88320  # of the usual CRC-32, lowest bit first


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


TABLE = _byte_table()


def _columns(matrix: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """Registers after all columns; ``matrix`` has a line for each column."""
    for column in matrix:
        registers = TABLE[(registers ^ column) & np.uint32(0xFF)] ^ (registers >> np.uint32(8))
    return registers


def _segment_map() -> np.ndarray:
    """For each of the four bytes of a register, what its 256 values become over a segment of zeros."""
    values = np.arange(256, dtype=np.uint32)
    start = np.concatenate([values << np.uint32(8 * i) for i in range(4)])
    return _columns(np.zeros((SEGMENT, 1), np.uint8), start).reshape(4, 256)


MOVED = _segment_map()


def _by_length(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, registers: np.ndarray) -> np.ndarray:
    order = np.argsort(sizes, kind="stable")
    out = registers.copy()
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        rows, size = order[a:b], int(sizes[order[a]])
        if size:
            out[rows] = _columns(flat[starts[rows] + np.arange(size)[:, None]], registers[rows])
    return out


def crc32(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings that lie end to end in ``flat``."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    heads = np.where(sizes > SEGMENT, sizes % SEGMENT, sizes)
    out = _by_length(flat, starts, heads, np.full(len(sizes), ONES, np.uint32))
    for row in np.flatnonzero(sizes > SEGMENT).tolist():
        at, register = int(starts[row] + heads[row]), int(out[row])
        lines = flat[at: int(starts[row] + sizes[row])].reshape(-1, SEGMENT)
        for own in _columns(lines.T, np.zeros(len(lines), np.uint32)).tolist():
            register = own ^ int(MOVED[0, register & 255] ^ MOVED[1, register >> 8 & 255] ^ MOVED[2, register >> 16 & 255] ^ MOVED[3, register >> 24])
        out[row] = register
    return out ^ ONES
