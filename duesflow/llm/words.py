"""Word boundaries and word hashes of many texts at once, without a Python object per word."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x):
    """A 64-bit hash of whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the runs of characters other than ASCII white space."""

    def __init__(self):
        self._bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._places = mix(np.arange(1001, 1001 + 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, texts: list[bytes]):
        """(hashes, first and one past last byte of each word, words of each text); bytes count over ``join(texts)``."""
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = np.concatenate([[False], ~SPACES[joined]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sizes = ends - starts
        letters = joined[inside[1:]]
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        values = self._bytes[letters] * self._places[place & 4095]
        if len(place) and place.max() >= 4096:
            # Beyond the table a place has the factor of its block of 4096 as well.
            values *= mix((place >> 12).astype(np.uint64)) | np.uint64(1)
        hashes = mix(np.add.reduceat(values, first)) if len(first) else np.empty(0, np.uint64)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        return hashes, starts, ends, np.diff(np.searchsorted(starts, bounds))

    @staticmethod
    def join(texts: list[bytes]) -> bytes:
        return b"\n".join([*texts, b""])
