"""A cuckoo filter over 64-bit digests, built and probed with whole arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
SLOTS = 4  # fingerprints in a bucket
LOAD = 0.5  # share of slots that a new filter is sized for
KICKS = 500  # moves before an insertion counts as failed


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; supports deletion of what was inserted.

    ``table`` is one array, so a filter is stored and sent as its bytes.
    """

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, SLOTS)

    @classmethod
    def sized(cls, items: int) -> CuckooFilter:
        """An empty filter for about so many items."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, items) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).copy())

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets."""
        digests = digests.astype(U)
        prints = ((digests >> U(48)) % U(65_535) + U(1)).astype(np.uint16)
        first = (digests & U(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, buckets, prints):
        """The other bucket, from either one and the fingerprint."""
        turn = (prints.astype(U) * U(0x9E3779B97F4A7C15)) >> U(20)
        return buckets ^ (turn & U(len(self.table) - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """Whether each may be held; never false for one that is."""
        prints, a, b = self._places(digests)
        wanted = prints[:, None]
        return (self.table[a] == wanted).any(axis=1) | (self.table[b] == wanted).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """Insert all; False if the filter is too full, which leaves it unfit for use."""
        prints, a, b = self._places(digests)
        prints, a, b = self._fill(a, prints, a, b)
        prints, a, b = self._fill(b, prints, a, b)
        for print_, bucket in zip(prints.tolist(), a.tolist(), strict=True):
            if not self._kick(print_, bucket):
                return False
        return True

    def _fill(self, buckets, prints, a, b):
        """Place what fits into free slots of ``buckets`` (``a`` or ``b``); the rest."""
        order = np.argsort(buckets, kind="stable")
        at = buckets[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        free = self.table[at] == 0
        fits = rank < free.sum(axis=1)
        # The rank-th free slot of the bucket.
        slot = np.argmax(np.cumsum(free[fits], axis=1) == (rank[fits] + 1)[:, None], axis=1)
        self.table[at[fits], slot] = prints[order][fits]
        rest = order[~fits]
        return prints[rest], a[rest], b[rest]

    def _kick(self, print_: int, bucket: int) -> bool:
        for step in range(KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
            slot = (print_ + step) % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Remove one fingerprint of each; they must have been inserted."""
        for print_, *buckets in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for bucket in buckets:
                found = np.flatnonzero(self.table[bucket] == print_)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
