"""Shingles of a text as hashes, and the fingerprint of hashes."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash

#: Shingles whose bits are unpacked at once.
CHUNK = 16_384


def shingle_hashes(raw: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of so many words, lower-cased and space-joined; the whole text if it has fewer."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    plain, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(plain, seed)], dtype=np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return np.fromiter((digest(plain[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)), dtype=np.uint64, count=len(found) - words + 1)


def fingerprint(hashes: np.ndarray, width: int) -> bytes:
    """The bits that are set in over half the hashes, little-endian. Words after the first mix the hash further."""
    counts = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        wide = np.empty((len(part), width), dtype="<u8")
        wide[:, 0] = part
        for k in range(1, width):  # splitmix64
            z = part + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = z ^ (z >> np.uint64(31))
        octets = wide.view(np.uint8)
        if len(part) < 4096:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8 * width):
                seen = np.bincount(octets[:, k], minlength=256)
                counts[8 * k : 8 * k + 8] += seen @ BITS_OF
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
