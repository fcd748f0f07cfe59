"""Elias-Fano sequences over memory-mapped arrays, queried many at a time."""

from __future__ import annotations

import json

import numpy as np

#: Bits of a block of the rank directory.
BLOCK = 256
#: SELECT[b, k]: the place of the k-th one in a byte.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
SELECT = np.zeros((256, 8), np.int64)
for _k in range(8):
    SELECT[:, _k] = (np.cumsum(_ONES, axis=1) > _k).argmax(axis=1)

#: Words of repeated bit patterns: 01, 0011, 00001111, 00000001 and 10000000.
_HALVES, _QUARTERS, _EIGHTHS, _EACH, _TOPS = (np.uint64((2**64 - 1) // d * m) for d, m in ((3, 1), (5, 1), (17, 1), (255, 1), (255, 128)))


class BitVector:
    """Bits with select for ones and for zeros."""

    def __init__(self, data: np.ndarray, ranks: np.ndarray):
        self.data, self.ranks, self._zeros = data, ranks, None

    @classmethod
    def build(cls, ones: np.ndarray, size: int) -> BitVector:
        """Bits of which ``ones`` (in order) are set."""
        blocks = -(-max(size, 1) // BLOCK)
        bits = np.zeros(blocks * BLOCK, np.uint8)
        bits[ones] = 1
        data = np.packbits(bits, bitorder="little")
        counts = np.bitwise_count(data).reshape(blocks, -1).sum(axis=1, dtype=np.int64)
        return cls(data, np.r_[0, np.cumsum(counts)])

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero, counted from 0."""
        if not one and self._zeros is None:
            self._zeros = np.arange(len(self.ranks)) * BLOCK - self.ranks
        ranks = self.ranks if one else self._zeros
        block = np.searchsorted(ranks, k, side="right") - 1
        left = k - ranks[block]
        flip = np.uint64(0 if one else 0xFFFFFFFFFFFFFFFF)
        words, at = self.data.view("<u8"), block * (BLOCK // 64)
        bits = words[at] ^ flip
        for _ in range(BLOCK // 64 - 1):
            ones = np.bitwise_count(bits)
            on = np.flatnonzero(left >= ones)
            if not len(on):
                break
            left[on] -= ones[on]
            at[on] += 1
            bits[on] = words[at[on]] ^ flip
        # ones up to each byte of a word, added in parallel
        sums = bits - ((bits >> np.uint64(1)) & _HALVES)
        sums = (sums & _QUARTERS) + ((sums >> np.uint64(2)) & _QUARTERS)
        sums = ((sums + (sums >> np.uint64(4))) & _EIGHTHS) * _EACH
        passed = ((((left.astype(np.uint64) * _EACH) | _TOPS) - sums) & _TOPS) >> np.uint64(7)
        shift = ((passed * _EACH) >> np.uint64(56)) << np.uint64(3)
        left -= (((sums << np.uint64(8)) >> shift) & np.uint64(255)).astype(np.int64)
        return at * 64 + shift.astype(np.int64) + SELECT[((bits >> shift) & np.uint64(255)).astype(np.int64), left]


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63 in about 2 + log2(universe / length) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: BitVector):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        parts = []
        for i in range(0, n, 1 << 16):  # a multiple of 8 values ends on a byte
            part = values[i : i + (1 << 16)]
            bits = (part[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros((len(part), 0), np.int64)
            parts.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"))
        size = sum(map(len, parts))
        low = np.concatenate([*parts, np.zeros(8 + -size % 8, np.uint8)])  # whole words, and one more
        buckets = (universe >> low_bits) + 1
        return cls(n, low_bits, low, BitVector.build((values >> low_bits) + np.arange(n), n + buckets))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        words, bit = self.low.view("<u8"), i * self.low_bits
        at, shift = bit >> 6, (bit & 63).view(np.uint64)
        got = words[at] >> shift
        at += 1
        got |= (words[at] << np.uint64(1)) << (np.uint64(63) - shift)
        got &= np.uint64((1 << self.low_bits) - 1)
        return got.view(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.int64)
        return ((self.high.select(i, True) - i) << self.low_bits) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place with at least each value (its successor); values lie below the universe."""
        return self._find(values)[0]

    def _find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those places, and where the values with the same high bits end."""
        if not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bucket = values >> self.low_bits
        start = np.where(bucket > 0, self.high.select(np.maximum(bucket - 1, 0), False) + 1 - bucket, 0)
        end = self.high.select(bucket, False) - bucket
        wanted = values & ((1 << self.low_bits) - 1)
        lo, hi = start, end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo, end
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < wanted[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def contains(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places as :meth:`find` gives them, and whether the values are there."""
        at, end = self._find(values)
        there = at < end
        there[there] = self._lows(at[there]) == values[there] & ((1 << self.low_bits) - 1)
        return at, there


# --- files: a line of JSON (names, types, places), then the arrays ------------------------------------------


def pack(arrays: dict[str, np.ndarray], sequences: dict[str, EliasFano], extra: dict) -> bytes:
    """One file of arrays and sequences."""
    flat, shapes = dict(arrays), {}
    for name, s in sequences.items():
        shapes[name] = [s.n, s.low_bits]
        flat |= {f"{name}.low": s.low, f"{name}.data": s.high.data, f"{name}.ranks": s.high.ranks}
    at, places, body = 0, {}, []
    for name, a in flat.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        places[name] = [a.dtype.str, at, len(a)]
        body.append(raw)
        at += len(raw)
    head = json.dumps({"places": places, "sequences": shapes, "extra": extra}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(body)


def unpack(data: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, EliasFano], dict]:
    """Views on a file that is memory-mapped as bytes; nothing is copied. They are plain arrays, as each index of a memmap runs Python code."""
    data = data.view(np.ndarray)
    size = 1 << 12
    while (end := bytes(data[:size]).find(b"\n")) < 0:
        size *= 2
    head, base = json.loads(bytes(data[:end])), end + 1
    arrays = {}
    for name, (kind, at, n) in head["places"].items():
        dtype = np.dtype(kind)
        arrays[name] = data[base + at : base + at + n * dtype.itemsize].view(dtype)
    sequences = {name: EliasFano(n, low_bits, arrays[f"{name}.low"], BitVector(arrays[f"{name}.data"], arrays[f"{name}.ranks"])) for name, (n, low_bits) in head["sequences"].items()}
    return arrays, sequences, head["extra"]
