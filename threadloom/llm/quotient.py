"""Counting quotient filters of packed id n-grams, lossless.

An n-gram of ids is packed into one number of ``WIDTH`` = size x bits bits, in
lanes of 64. A permutation of these numbers, which can be undone, spreads them
evenly. The first bits of the result name the shard. Of what is left the first
bits are the quotient and all others the remainder, kept whole: nothing is lost,
so a filter counts exactly and gives its n-grams back. A finished filter holds,
in order, one bit for each quotient that occurs, one bit for each entry that is
its quotient's last, the remainders, and the counts (one byte, larger ones aside).
"""

from typing import NamedTuple

import numpy as np

from threadloom.llm import words as W

_ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Packing(NamedTuple):
    """``size`` ids of ``bits`` bits each; id 0 is no word."""

    size: int
    bits: int

    @property
    def lanes(self) -> int:
        return -(-self.size * self.bits // 64) if self.bits < 64 else self.size

    @property
    def width(self) -> int:
        """Bits of the first lane in use."""
        return self.size * self.bits if self.lanes == 1 else 64


def pack(ids: np.ndarray, packing: Packing) -> np.ndarray:
    """(size, m) ids to (lanes, m) numbers."""
    out = np.zeros((packing.lanes, ids.shape[1]), np.uint64)
    if packing.bits == 64:
        out[:] = ids
        return out
    for k in range(packing.size):
        at, low = divmod(k * packing.bits, 64)
        out[at] |= ids[k] << np.uint64(low)
        if low + packing.bits > 64:
            out[at + 1] |= ids[k] >> np.uint64(64 - low)
    return out


def unpack(packed: np.ndarray, packing: Packing) -> np.ndarray:
    if packing.bits == 64:
        return packed.copy()
    mask = np.uint64((1 << packing.bits) - 1)
    out = np.zeros((packing.size, packed.shape[1]), np.uint64)
    for k in range(packing.size):
        at, low = divmod(k * packing.bits, 64)
        out[k] = packed[at] >> np.uint64(low)
        if low + packing.bits > 64:
            out[k] |= packed[at + 1] << np.uint64(64 - low)
        out[k] &= mask
    return out


def permute(packed: np.ndarray, packing: Packing) -> np.ndarray:
    """A bijection on the numbers of a packing."""
    x = packed.copy()
    if len(x) == 1:
        mask, half = np.uint64((1 << packing.width) - 1), np.uint64((packing.width + 1) // 2)
        for odd in _ODD:
            x[0] = x[0] * np.uint64(odd) & mask
            x[0] ^= x[0] >> half
        return x
    for r in range(2 * len(x)):
        i = r % len(x)
        x[i] ^= W.mix(x[i - 1] + np.uint64((r + 1) * _ODD[0] % 2**64))
    return x


def restore(permuted: np.ndarray, packing: Packing) -> np.ndarray:
    x = permuted.copy()
    if len(x) == 1:
        mask, half = np.uint64((1 << packing.width) - 1), np.uint64((packing.width + 1) // 2)
        for odd in reversed(_ODD):
            x[0] ^= x[0] >> half
            x[0] = x[0] * np.uint64(pow(odd, -1, 1 << packing.width)) & mask
        return x
    for r in reversed(range(2 * len(x))):
        i = r % len(x)
        x[i] ^= W.mix(x[i - 1] + np.uint64((r + 1) * _ODD[0] % 2**64))
    return x


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts (1 each by default)."""
    if not keys.shape[1]:
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    total = np.diff(np.r_[new, keys.shape[1]]) if counts is None else np.add.reduceat(counts[order], new)
    return keys[:, new], total


def _tops(keys: np.ndarray, packing: Packing, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each key."""
    return (keys[0] >> np.uint64(packing.width - bits)).astype(np.int64) if bits else np.zeros(keys.shape[1], np.int64)


def shards_of(keys: np.ndarray, packing: Packing, shard_bits: int) -> np.ndarray:
    return _tops(keys, packing, min(shard_bits, packing.width))


def dump(keys: np.ndarray, counts: np.ndarray, packing: Packing, shard_bits: int) -> bytes:
    """Filter of sorted distinct keys of one shard."""
    m = keys.shape[1]
    shard_bits = min(shard_bits, packing.width)
    q_bits = min(packing.width - shard_bits, max(0, m.bit_length() - 1))
    left = packing.width - shard_bits - q_bits  # bits of the first lane in the remainder
    quotient = _tops(keys, packing, shard_bits + q_bits) & ((1 << q_bits) - 1)
    occupied = np.zeros(1 << q_bits, np.uint8)
    occupied[quotient] = 1
    last = np.r_[quotient[1:] != quotient[:-1], True].astype(np.uint8)
    rest = keys[0] & np.uint64((1 << left) - 1)
    size = -(-left // 8)
    remainder = rest.astype("<u8").view(np.uint8).reshape(m, 8)[:, :size]
    large = np.flatnonzero(counts > 255)
    parts = [
        np.array([m, q_bits, len(large)], "<u8").tobytes(),
        np.packbits(occupied).tobytes(),
        np.packbits(last).tobytes(),
        remainder.tobytes(),
        keys[1:].astype("<u8").tobytes(),
        np.where(counts > 255, 0, counts).astype(np.uint8).tobytes(),
        large.astype("<u8").tobytes(),
        counts[large].astype("<u8").tobytes(),
    ]
    return b"".join(parts)


def load(raw: bytes, packing: Packing, shard: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a filter, in order."""
    shard_bits = min(shard_bits, packing.width)
    m, q_bits, n_large = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    left = packing.width - shard_bits - q_bits
    at = 24

    def take(n: int, kind=np.uint8):
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    slots = np.flatnonzero(np.unpackbits(take(-(-(1 << q_bits) // 8)), count=1 << q_bits))
    last = np.unpackbits(take(-(-m // 8)), count=m)
    quotient = slots[np.cumsum(last) - last]
    size = -(-left // 8)
    rest = np.zeros((m, 8), np.uint8)
    rest[:, :size] = take(m * size).reshape(m, size)
    keys = np.zeros((packing.lanes, m), np.uint64)
    top = (np.uint64(shard) << np.uint64(q_bits)) | quotient.astype(np.uint64)
    keys[0] = rest.view("<u8").ravel() | (top << np.uint64(left) if left < 64 else np.uint64(0))
    keys[1:] = take(m * (packing.lanes - 1), "<u8").reshape(packing.lanes - 1, m)
    counts = take(m).astype(np.int64)
    large = take(n_large, "<u8").astype(np.int64)
    counts[large] = take(n_large, "<u8").astype(np.int64)
    return keys, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter's keys and counts out of several."""
    return tally(np.concatenate([k for k, _ in filters], axis=1), np.concatenate([c for _, c in filters]))
