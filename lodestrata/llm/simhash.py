"""SimHash fingerprints of word shingles, computed in batches inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import xxhash

#: Shingles whose bits are counted at once.
CHUNK = 1 << 17


def shingle_hashes(text: str, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; of the whole sequence if there are fewer words.

    A-Z are lower-cased; words are what space, tab to return leave between them.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    return [h(joined[a : b - 1], 42) for a, b in zip(ends, ends[width:])]


def majority(hashes: Sequence[Sequence[int] | np.ndarray]) -> np.ndarray:
    """For each list: the 64-bit number whose bits are set in over half the list's hashes; zero for none."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    ones = np.zeros((len(hashes), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(hashes)), lengths)
    flat = np.concatenate([np.asarray(h, dtype=np.uint64) for h in hashes]) if len(hashes) else np.zeros(0, np.uint64)
    for at in range(0, len(flat), CHUNK):
        bits = np.unpackbits(flat[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + CHUNK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    for i in range(64):
        out |= (2 * ones[:, i] > lengths).astype(np.uint64) << np.uint64(i)
    return out
