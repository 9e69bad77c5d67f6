"""A minimal perfect hash over pairs of unsigned 64-bit integers, as levels of bit arrays with ranks.

Each level hashes the keys that are left into ``gamma`` bits a key; keys alone
in their place get that bit, the others go to the next level. A key's slot is
the rank of its bit over all levels, so n keys fill the slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.common import mixed

GAMMA = 1.7
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * int(_STEP)) % 2**64)
    return mixed(a ^ mixed(b + seed)) % np.uint64(size)


class PerfectHash:
    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits  # one array of 64-bit words a level
        self.sizes = [64 * len(x) for x in bits]
        counts = [np.bitwise_count(x).astype(np.int64) for x in bits]
        self.ranks, before = [], 0
        for c in counts:
            self.ranks.append(before + np.cumsum(c) - c)
            before += int(c.sum())
        self.n = before

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """a, b: distinct pairs of unsigned 64-bit integers."""
        bits, level = [], 0
        while len(a):
            if level > 200:
                raise ValueError("the keys are not distinct")
            size = 64 * max(1, -(-int(GAMMA * len(a)) // 64))
            at = _place(a, b, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at.astype(np.int64)] == 1
            flags = np.zeros(size, dtype=np.uint8)
            flags[at[alone].astype(np.int64)] = 1
            bits.append(np.packbits(flags, bitorder="little").view(np.uint64))
            a, b, level = a[~alone], b[~alone], level + 1
        return cls(bits)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level holds it. Keys that were never indexed may get any slot."""
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (words, ranks, size) in enumerate(zip(self.bits, self.ranks, self.sizes, strict=True)):
            if not len(left):
                break
            at = _place(a[left], b[left], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            here = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = ranks[word[here]] + below[here]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), *map(len, self.bits)], dtype=np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash, and the number of bytes it took."""
        levels = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, bits = np.frombuffer(data, np.int64, levels, 8), 8 * (levels + 1), []
        for n in sizes:
            bits.append(np.frombuffer(data, np.uint64, int(n), at))
            at += 8 * int(n)
        return cls(bits), at


class PerfectTable:
    """A perfect hash with a fingerprint of each key and parallel value arrays."""

    def __init__(self, index: PerfectHash, fingerprints: np.ndarray, values: dict[str, np.ndarray]):
        self.index, self.fingerprints, self.values = index, fingerprints, values

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, **values: np.ndarray) -> PerfectTable:
        index = PerfectHash.build(a, b)
        order = np.empty(len(a), dtype=np.int64)
        order[index.slots(a, b)] = np.arange(len(a))
        return cls(index, (b >> np.uint64(32)).astype(np.uint32)[order], {k: v[order] for k, v in values.items()})

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of these keys; -1 for those whose fingerprint differs."""
        slots = self.index.slots(a, b)
        if not self.index.n:
            return slots
        known = self.fingerprints[np.maximum(slots, 0)] == (b >> np.uint64(32)).astype(np.uint32)
        return np.where((slots >= 0) & known, slots, -1)

    def to_bytes(self) -> bytes:
        names = list(self.values)
        head = ";".join(f"{k},{self.values[k].dtype.str}" for k in names).encode()
        return np.int64(len(head)).tobytes() + head + self.index.to_bytes() + self.fingerprints.tobytes() + b"".join(self.values[k].tobytes() for k in names)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectTable:
        size = int(np.frombuffer(data, np.int64, 1)[0])
        names = [x.split(",") for x in data[8 : 8 + size].decode().split(";") if x]
        index, used = PerfectHash.from_bytes(data[8 + size :])
        at = 8 + size + used
        fingerprints = np.frombuffer(data, np.uint32, index.n, at)
        at, values = at + 4 * index.n, {}
        for name, kind in names:
            values[name] = np.frombuffer(data, np.dtype(kind), index.n, at)
            at += values[name].nbytes
        return cls(index, fingerprints, values)
