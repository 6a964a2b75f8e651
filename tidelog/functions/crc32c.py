"""CRC-32C of many byte ranges at a time, with numpy.

Spark has only the IEEE polynomial. Ranges are handled side by side: byte j of all of them in one step.
Long ranges are cut into blocks that are handled side by side as well and then joined, as the register
is linear over GF(2).
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Reflected Castagnoli polynomial.
POLY = 0x82F63B78
BLOCK = 128


@cache
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(POLY), np.uint32(0))
    return t


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return byte_table()[(state ^ byte) & 0xFF] ^ (state >> 8)


@cache
def block_tables() -> list[np.ndarray]:
    """What BLOCK zero bytes do to each byte of the register."""
    out = []
    for i in range(4):
        s = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        for _ in range(BLOCK):
            s = _step(s, 0)
        out.append(s)
    return out


def crc32c_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """uint32 checksums of data[start:start+length] (uint8); lengths may be 0."""
    n = len(start)
    state = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    if not n:
        return state
    start, length = start.astype(np.int64), length.astype(np.int64)
    head, blocks = length % BLOCK, length // BLOCK
    by_head = np.argsort(-head, kind="stable")
    at, left = start[by_head], head[by_head]
    regs = state[by_head]
    active = n - np.cumsum(np.bincount(left, minlength=BLOCK))  # how many have more than j bytes
    for j in range(int(left[0])):
        m = active[j]
        regs[:m] = _step(regs[:m], data[at[:m] + j])
    state[by_head] = regs
    total = int(blocks.sum())
    if total:
        first = np.cumsum(blocks) - blocks
        at = np.repeat(start + head - first * BLOCK, blocks) + np.arange(total) * BLOCK
        raw = np.zeros(total, dtype=np.uint32)
        for j in range(BLOCK):
            raw = _step(raw, data[at + j])
        t0, t1, t2, t3 = block_tables()
        for level in range(int(blocks.max())):
            on = np.nonzero(blocks > level)[0]
            s = state[on]
            state[on] = t0[s & 0xFF] ^ t1[(s >> 8) & 0xFF] ^ t2[(s >> 16) & 0xFF] ^ t3[s >> 24] ^ raw[first[on] + level]
    return state ^ np.uint32(0xFFFFFFFF)


#: Bytes up to which one checksum is taken byte by byte.
SHORT = 2048


@cache
def _table() -> list[int]:
    return byte_table().tolist()


def crc32c(data: bytes) -> int:
    if len(data) > SHORT:
        return int(crc32c_ranges(np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)]))[0])
    state, table = 0xFFFFFFFF, _table()
    for byte in data:
        state = table[(state ^ byte) & 0xFF] ^ (state >> 8)
    return state ^ 0xFFFFFFFF
