"""Static 3-wise binary-fuse filters over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + _U(seed)
        h ^= h >> _U(33)
        h *= _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(33)
        h *= _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots for each key, in three segments that follow one another."""
    window = segments * segment
    base = ((h >> _U(32)) * _U(window)) >> _U(32)
    mask = _U(segment - 1)
    one = (base + _U(segment)) ^ ((h >> _U(18)) & mask)
    two = (base + _U(2 * segment)) ^ (h & mask)
    return np.stack([base, one, two]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of 16-bit fingerprints that holds every key; other keys pass with a chance of 2**-16.

    Keys are peeled in rounds: all that stand alone in a slot leave together, since none of them touches another's own
    slot, and are assigned in the opposite order. A seed that does not peel is replaced.
    """
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    if not n:
        return b""
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    for seed in range(1, 1000):
        segments = max(1, math.ceil(n * factor / segment) - 2) + seed // 20
        size = (segments + 2) * segment
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        slots = _slots(h, segment, segments)
        left, order, own = np.arange(n), [], []
        while len(left):
            at = slots[:, left]
            count = np.bincount(at.ravel(), minlength=size)
            alone = count[at] == 1
            goes = alone.any(axis=0)
            if not goes.any():
                break
            pick = alone[:, goes].argmax(axis=0)
            order.append(left[goes])
            own.append(at[:, goes][pick, np.arange(len(pick))])
            left = left[~goes]
        if len(left):
            continue
        table, want = np.zeros(size, np.uint16), _prints(h)
        for k, slot in zip(reversed(order), reversed(own), strict=True):
            a, b, c = slots[:, k]
            table[slot] = 0
            table[slot] = want[k] ^ table[a] ^ table[b] ^ table[c]
        return struct.pack("<QQQ", seed, segment, segments) + table.tobytes()
    raise ValueError("no seed peels these keys")


def contains(filter_: bytes | None, keys: np.ndarray) -> np.ndarray:
    if not filter_:
        return np.zeros(len(keys), bool)
    seed, segment, segments = struct.unpack_from("<QQQ", filter_)
    table = np.frombuffer(filter_, np.uint16, offset=24)
    h = _mix(keys.astype(_U), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b, c = _slots(h, segment, segments)
    return _prints(h) == table[a] ^ table[b] ^ table[c]
