"""Counting quotient filters of packed word-id n-grams: lossless counters, kept sorted, merged and sent in pieces.

An n-gram of word ids of ``bits`` bits is packed into limbs of up to 64 bits. The first limb, after the others were
folded into it, goes through an invertible permutation of its own bits: its high bits are the quotient, which deals
n-grams evenly whatever words they hold, the low bits and the other limbs the remainder. Both together give the n-gram
back, so counts are exact. A piece holds the entries of one bucket, that is of one value of the quotient's first bits,
in order: a run length for each quotient, remainders in as few bytes as they need, and counters of one byte with larger
ones apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np

#: Odd numbers; a product with one can be undone.
STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LARGE = 255

Limbs = list[np.ndarray]


def ones(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """Bits moved down; 64 or more leave nothing."""
    return x >> np.uint64(by) if by < 64 else np.zeros_like(x)


def permuted(x: np.ndarray, width: int) -> np.ndarray:
    for step in STEPS:
        x = (x * np.uint64(step)) & ones(width)
        x = x ^ shifted(x, (width + 1) // 2)
    return x


def restored(x: np.ndarray, width: int) -> np.ndarray:
    for step in reversed(STEPS):
        x = x ^ shifted(x, (width + 1) // 2)
        x = (x * np.uint64(pow(step, -1, 1 << 64))) & ones(width)
    return x


class Packing:
    """How n-grams of ``n`` ids from 1 to 2^bits - 1 are laid out."""

    def __init__(self, n: int, bits: int) -> None:
        self.n, self.bits, per = n, bits, 64 // bits
        self.words = [min(per, n - i) for i in range(0, n, per)]
        self.widths = [w * bits for w in self.words]

    def folded(self, rest: Limbs) -> np.ndarray | np.uint64:
        x = np.uint64(0)
        for i, limb in enumerate(rest):
            x = x ^ permuted(limb + np.uint64(i + 1), 64)
        return shifted(x, 64 - self.widths[0]) if rest else x

    def pack(self, ids: np.ndarray, starts: np.ndarray) -> Limbs:
        """The n-grams that begin at ``starts`` of ``ids`` (uint64), permuted."""
        limbs, at = [], 0
        for words in self.words:
            x = np.zeros(len(starts), np.uint64)
            for _ in range(words):
                x = (x << np.uint64(self.bits)) | ids[starts + at]
                at += 1
            limbs.append(x)
        return [permuted(limbs[0] ^ self.folded(limbs[1:]), self.widths[0]), *limbs[1:]]

    def unpack(self, limbs: Limbs) -> np.ndarray:
        """One row of ids for each n-gram."""
        plain = [restored(limbs[0], self.widths[0]) ^ self.folded(limbs[1:]), *limbs[1:]]
        parts = [(x >> np.uint64((words - 1 - i) * self.bits)) & ones(self.bits) for x, words in zip(plain, self.words, strict=True) for i in range(words)]
        return np.stack(parts, axis=1).astype(np.int32)

    def quotient(self, limbs: Limbs, bits: int) -> np.ndarray:
        return shifted(limbs[0], self.widths[0] - bits)


def merged(parts: list[tuple[Limbs, np.ndarray]]) -> tuple[Limbs, np.ndarray]:
    """Entries of several filters in order, each n-gram once with the sum of its counts."""
    limbs = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [x[order] for x in limbs]
    new = np.ones(len(counts), bool)
    if len(counts):
        new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
        counts = np.add.reduceat(counts[order], np.flatnonzero(new))
    return [x[new] for x in limbs], counts


def _bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)].tobytes()


def _numbers(blob: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = -(-width // 8)
    x = np.zeros((n, 8), np.uint8)
    x[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
    return x.view("<u8").ravel(), at + n * size


def write(packing: Packing, limbs: Limbs, counts: np.ndarray, top: int) -> bytes:
    """A piece: entries, in order, that share the first ``top`` bits of the quotient."""
    n, width = len(counts), packing.widths[0] - top
    low = limbs[0] & ones(width)
    q = min(width, max(n.bit_length() - 1, 0))
    runs = np.bincount(shifted(low, width - q).astype(np.int64), minlength=1 << q)
    wide = 1 if runs.max() < 1 << 8 else 4
    large = counts >= LARGE
    head = np.array([n, q, wide, large.sum()], "<i8").tobytes()
    rest = b"".join(_bytes(x, w) for x, w in zip(limbs[1:], packing.widths[1:], strict=True))
    return head + runs.astype(f"<u{wide}").tobytes() + _bytes(low & ones(width - q), width - q) + rest + np.where(large, LARGE, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def read(packing: Packing, blob: bytes, bucket: int, top: int) -> tuple[Limbs, np.ndarray]:
    n, q, wide, large = np.frombuffer(blob, "<i8", 4).tolist()
    at, width = 32, packing.widths[0] - top
    runs = np.frombuffer(blob, f"<u{wide}", 1 << q, at).astype(np.int64)
    quotients = np.repeat(np.arange(1 << q, dtype=np.uint64), runs)
    low, at = _numbers(blob, at + (wide << q), n, width - q)
    first = low | (quotients << np.uint64(width - q) if q else np.uint64(0))
    limbs = [first | (np.uint64(bucket << width) if top else np.uint64(0))]
    for w in packing.widths[1:]:
        x, at = _numbers(blob, at, n, w)
        limbs.append(x)
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(blob, "<i8", large, at + n)
    return limbs, counts


def pieces(packing: Packing, limbs: Limbs, counts: np.ndarray, top: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, piece) of the buckets that hold something."""
    of = packing.quotient(limbs, top)
    starts = [*np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[: len(of)]), len(of)]
    for a, b in pairwise(starts):
        yield int(of[a]), write(packing, [x[a:b] for x in limbs], counts[a:b], top)
