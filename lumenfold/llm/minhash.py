"""MinHash signatures: bands tuned to a recall at a Jaccard similarity, and one-bit sketches of the minima."""

from __future__ import annotations

import numpy as np

SEED = 42
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Minima a text may have, and the bits of 64 in which candidates may differ (6.4 on average at 0.8).
MOST_MINIMA, SKETCH_BITS, SKETCH_RADIUS = 128, 64, 17


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_MINIMA) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest chance candidates, that reach the recall."""
    for rows in range(most, 0, -1):
        miss = 1 - similarity**rows
        bands = 1
        while bands * rows <= most and miss**bands > 1 - recall:
            bands += 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches the recall")


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signature(hashes: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], int]:
    """The bands' hashes, and a sketch of one bit of each of the first 64 minima."""
    minima = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096]
        h = h ^ (h >> np.uint64(29))
        minima = np.minimum(minima, (h[None, :] * a[:, None] + b[:, None]).min(1))
    keys = minima[: bands * rows].reshape(bands, rows)
    mixed = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        mixed = (mixed ^ keys[:, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
    bits = (minima[:SKETCH_BITS] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
    sketch = int.from_bytes(np.packbits(bits.astype(np.uint8)).tobytes(), "big", signed=True)
    return mixed.astype(np.int64).tolist(), sketch
