"""256-bit fingerprints of shingle sets and the radii at which no similar pair is lost.

SimHash: each shingle's hash votes on 256 bits. For two sets the bits differ
independently, each with the chance that two sums of random signs differ in sign,
so the number of differing bits is binomial. For sets of LONG shingles or more and
a similarity of 0.8 or more that chance is at most 0.156, and more than RADIUS bits
differ in fewer than one of 10^11 pairs; unrelated sets are within RADIUS in 3 of
10^8. Smaller sets are told apart by parities instead: each shingle flips one of 256
bits, so two sets can't differ in more bits than shingles, whatever the hashes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash

WORDS = 4
BITS = 64 * WORDS
#: Shingles from which on the SimHash serves.
LONG = 32
#: Bits that the SimHashes of sets of LONG shingles or more may differ in.
RADIUS = 84

_low, _high = partial(xxhash.xxh3_128_digest, seed=0), partial(xxhash.xxh3_128_digest, seed=1)


def digests(parts: list[bytes]) -> np.ndarray:
    """(n, 32) bytes of hash."""
    out = np.frombuffer(b"".join(map(_low, parts)) + b"".join(map(_high, parts)), np.uint8).reshape(2, len(parts), 16)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(parts), 32)


def votes(d: np.ndarray) -> np.ndarray:
    """(n, 256) bits of digests."""
    return np.unpackbits(d, axis=1, bitorder="little")


def pack(bits: np.ndarray) -> np.ndarray:
    """(..., 4) words of (..., 256) bits."""
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


def simhash(d: np.ndarray) -> np.ndarray:
    """Four words: a bit is set if it is in over half of the digests."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(d), 1 << 16):
        sums += votes(d[at : at + (1 << 16)]).sum(axis=0, dtype=np.int32)
    return pack(2 * sums > len(d))


def parity(d: np.ndarray) -> np.ndarray:
    """Four words: a bit is set if an odd number of digests begin with its number."""
    return pack((np.bincount(d[:, 0], minlength=BITS) & 1).astype(np.uint8))


def parity_radius(n: np.ndarray | int, like: float) -> np.ndarray:
    """Most parity bits that differ between sets of ``n`` shingles together whose
    similarity is ``like`` or more: what is in one set only."""
    return np.floor((1 - like) / (1 + like) * np.asarray(n) + 1e-9).astype(np.int64)


def simhash_radius(like: float) -> int:
    """RADIUS from 0.8 on; for less alike sets no radius is proven, so all bits."""
    return RADIUS if like >= 0.8 - 1e-9 else BITS


def longest_partner(n: int, like: float) -> int:
    """Shingles that a set similar to one of n has at most."""
    return int(n / like + 1e-9)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
