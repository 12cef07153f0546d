"""Hashes of byte ranges and of runs of hashes, a whole batch at a time.

Plain polynomials modulo 2**64 are not used: for every odd base they give certain pairs of long words one value. Ranges of bytes go through a
bijective mixer eight bytes at a time; runs of hashes are polynomials modulo the prime 2**61 - 1 at random points.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer byte ranges are hashed one by one.
LONG = 256
P = np.uint64((1 << 61) - 1)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Two random points of the field, fixed so that reruns agree, and their inverses.
_BASES = tuple(int(x) for x in np.random.default_rng(20_261).integers(1 << 40, (1 << 61) - 2, 2))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for the bytes of each range; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n, lanes = ends - starts, _lanes(buf)
    with np.errstate(over="ignore"):
        h = mix(mix(n.astype(np.uint64) * _GOLD) ^ (lanes[starts] & _MASK[np.minimum(n, 8)]))
    at, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(at):
        left = n[at] - k
        h[at] = mix(h[at] ^ (lanes[starts[at] + k] & _MASK[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether the bytes of range i are those of range ``to[i]``."""
    n = ends - starts
    same = n == n[to]
    other = np.flatnonzero(same & (to != np.arange(len(to))))
    at, k = other[n[other] <= LONG], 0
    lanes = _lanes(buf)
    while len(at):
        left = n[at] - k
        at, left = at[left > 0], left[left > 0]
        equal = (lanes[starts[at] + k] ^ lanes[starts[to[at]] + k]) & _MASK[np.minimum(left, 8)] == 0
        same[at[~equal]] = False
        at, k = at[equal], k + 8
    for i in other[n[other] > LONG].tolist():
        j = to[i]
        same[i] = np.array_equal(buf[starts[i] : ends[i]], buf[starts[j] : ends[j]])
    return same


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> np.uint64(61))
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product modulo ``P`` of numbers below it, from parts of 31 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = a1 * b0 + a0 * b1
    half = np.uint64((1 << 30) - 1)
    return _reduce((a1 * b1 << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & half) << np.uint64(31)) + a0 * b0)


def _power(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` up to the n-th, each doubling from the ones before."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) <= n:
        have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), int(P))))])
    _powers[base] = have
    return have


def run_digests(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two numbers, for each run ``h[a:b]``; equal runs have equal digests wherever they stand."""
    out = []
    for base, x in zip(_BASES, (h, mix(h ^ _GOLD)), strict=True):
        term = times(_reduce(x), _power(base, len(h))[: len(h)])
        low = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term & np.uint64(0xFFFFFFFF), dtype=np.uint64)])
        high = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term >> np.uint64(32), dtype=np.uint64)])
        total = _reduce(times(_reduce(high[b] - high[a]), np.uint64(1 << 32)) + _reduce(low[b] - low[a]))
        back = _power(pow(base, -1, int(P)), len(h))
        with np.errstate(over="ignore"):
            out.append(mix(times(total, back[a]) ^ ((b - a).astype(np.uint64) * _GOLD)).view(np.int64))
    return out[0], out[1]
