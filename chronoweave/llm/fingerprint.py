"""SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Shingles whose bits are counted at once: 64 bytes each.
BLOCK = 1 << 17


def shingle_hashes(text: str | None, n: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``n`` words, repeats included, as unsigned 64-bit integers.

    A-Z count in lower case. A text of fewer words is one shingle, a text
    without words (or null) has none. ``bytes.split`` parts words at \\x20 and
    \\x09 to \\x0D, as is meant here.
    """
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(ws) < n:
        return np.array([h(b" ".join(ws), seed)], np.uint64)
    if n == 3:
        return np.array([h(b"%b %b %b" % t, seed) for t in zip(ws, ws[1:], ws[2:])], np.uint64)
    return np.array([h(b" ".join(ws[i : i + n]), seed) for i in range(len(ws) - n + 1)], np.uint64)


#: For each byte, its eight bits as the bytes of one number, the highest first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def _bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of 64 bits, the highest first, is set in the runs of hashes that start at ``first``.

    Bits are added up as bytes, eight in one number, in steps that no byte overflows.
    """
    steps = np.union1d(first, np.arange(0, len(hashes), 255))
    lanes = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, steps, axis=0).view(np.uint8).reshape(len(steps), 64)
    return np.add.reduceat(sums, np.searchsorted(steps, first), axis=0, dtype=np.int64)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes of hashes, others for each word; word 0 are the hashes themselves (the finaliser of SplitMix64)."""
    if not word:
        return hashes
    h = hashes ^ np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash(lists: list[np.ndarray], words: int = 1) -> np.ndarray:
    """Fingerprints of ``words`` times 64 bits, a row for each list: a bit is 1 if it is set in over half the hashes; zero without hashes."""
    sizes = np.array([len(x) for x in lists], np.int64)  # without lists it would be of floats
    counts = np.zeros((words, len(lists), 64), np.int64)
    flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    for at in range(0, len(flat), BLOCK):
        own = owner[at : at + BLOCK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for word in range(words):
            counts[word, own[first]] += _bit_counts(_mixed(flat[at : at + BLOCK], word), first)
    return np.packbits(2 * counts > sizes[None, :, None], axis=2).view(">u8").reshape(words, len(lists)).astype(np.uint64).T


def fingerprint_batches(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: (doc_id, text) to (doc_id, fp), some texts at a time."""
    for batch in batches:
        fps, held, size = [], [], 0
        for text in batch.column(1):
            held.append(shingle_hashes(text.as_py(), n, seed))
            size += len(held[-1])
            if size >= BLOCK:
                fps.append(simhash(held))
                held, size = [], 0
        fps.append(simhash(held))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps)[:, 0].copy().view(np.int64))], ["doc_id", "fp"])
