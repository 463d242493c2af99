"""Static binary-fuse filters over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

HEAD = struct.Struct("<QII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _slots(h: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(width * segments)) >> np.uint64(32)
    mask = np.uint64(width - 1)
    second = (first + np.uint64(width)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * width)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(16))).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds every given key; a key outside is let through once in about 65,000 times."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = len(keys)
    width = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    for seed in range(1, 200):
        segments = max(1, -(-int(n * factor + 8) // width) - 2) + seed // 8
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        slots = _slots(h, width, segments)
        size = width * (segments + 2)
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        layers, done = [], 0
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            who, at = np.unique(owner[ready], return_index=True)
            cell = ready[at]
            layers.append((who, cell))
            done += len(who)
            for row in slots:
                np.subtract.at(degree, row[who], 1)
                np.bitwise_xor.at(owner, row[who], who)
            touched = np.unique(slots[:, who])
            ready = touched[degree[touched] == 1]
        if done < n:
            continue
        cells = np.zeros(size, dtype=np.uint16)
        marks = _prints(h)
        for who, cell in reversed(layers):
            cells[cell] = 0
            a, b, c = slots[:, who]
            cells[cell] = marks[who] ^ cells[a] ^ cells[b] ^ cells[c]
        return HEAD.pack(seed, width, segments) + cells.tobytes()
    raise ValueError("no seed peels these keys")


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, whether the filter may hold it."""
    seed, width, segments = HEAD.unpack_from(filter_bytes)
    cells = np.frombuffer(filter_bytes, dtype=np.uint16, offset=HEAD.size)
    h = _mix(np.asarray(keys).astype(np.uint64), seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    a, b, c = _slots(h, width, segments)
    return (cells[a] ^ cells[b] ^ cells[c]) == _prints(h)
