"""Words of UTF-8 texts as spans of bytes: hashing and comparing many of them at once."""

from __future__ import annotations

import numpy as np
import xxhash

# Spans longer than this are hashed and compared one at a time.
LONG_SPAN = 256

_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Block:
    """Bytes whose spans can be hashed and compared."""

    def __init__(self, data: bytes) -> None:
        self.size = len(data)
        self.data = data + b"\0" * 8
        self.bytes = np.frombuffer(self.data, np.uint8)
        # The eight bytes from every position on.
        self._eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=self.data, strides=(1,))

    def _piece(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._eights[starts] & _KEEP[np.minimum(lengths, 8)]

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every span."""
        found = mixed(self._piece(starts, lengths) + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        rest, done = np.flatnonzero(lengths > 8), 8
        while len(rest) and done < LONG_SPAN:
            piece = self._piece(starts[rest] + done, lengths[rest] - done)
            found[rest] = mixed(found[rest] * np.uint64(3) + piece)
            done += 8
            rest = rest[lengths[rest] > done]
        for at in rest.tolist():
            found[at] = xxhash.xxh3_64_intdigest(memoryview(self.data)[starts[at] : starts[at] + lengths[at]])
        return found

    def same(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the spans of equal lengths from ``a`` and from ``b`` on hold the same bytes."""
        equal = self._piece(a, lengths) == self._piece(b, lengths)
        rest, done = np.flatnonzero(equal & (lengths > 8)), 8
        while len(rest) and done < LONG_SPAN:
            size = lengths[rest] - done
            alike = self._piece(a[rest] + done, size) == self._piece(b[rest] + done, size)
            equal[rest[~alike]] = False
            done += 8
            rest = rest[alike & (size > 8)]
        view = memoryview(self.data)
        for at in rest.tolist():
            equal[at] = view[a[at] : a[at] + lengths[at]] == view[b[at] : b[at] + lengths[at]]
        return equal
