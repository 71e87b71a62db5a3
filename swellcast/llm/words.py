"""Vectorised words of a batch of texts: ``[^\\x20\\x09-\\x0D]+`` and 64-bit
hashes of them, with NumPy over the joined UTF-8 bytes (no loop per word)."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

U = np.uint64
_M1, _M2, _K = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
_S33 = U(33)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
_LONG = 1024  # bytes; longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


@dataclass
class Words:
    """Words of several texts in one buffer. Word ``i`` is
    ``buf[start[i]:end[i]]``; text ``d`` owns words ``ptr[d]:ptr[d + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end)


def words(texts: list[str], lower: bool = False) -> Words:
    """Find the words of every text; ``lower`` lower-cases A-Z only."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        buf = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[0::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) if raw else np.zeros(1, np.int64)
    return Words(buf, start, end, np.searchsorted(start, at))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash each ``buf[start:end]``, eight bytes at a time over all spans."""
    n = end - start
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", pad, strides=(1,))
    h = mix(n.astype(U) * _K + _M1)
    live = np.flatnonzero(n <= _LONG)
    k = 0
    while live.size:
        left = n[live] - k
        go = left > 0
        if not go.all():
            live, left = live[go], left[go]
        h[live] = mix(h[live] * _K ^ (lanes[start[live] + k] & _MASKS[np.minimum(left, 8)]))
        live = live[left > 8]
        k += 8
    for i in np.flatnonzero(n > _LONG):
        h[i] = int.from_bytes(blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Ordered hashes of all runs of ``n`` consecutive entries."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for i in range(n):
        out = mix(out * _K + h[i:len(h) - n + 1 + i] + U(i + 1))
    return out
