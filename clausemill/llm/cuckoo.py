"""A cuckoo filter over 64-bit hashes: four 16-bit prints a bucket, deletion, and bytes to keep it in a table."""

from __future__ import annotations

import numpy as np

from clausemill.llm.words import mix

_U = np.uint64
_KICKS = 500


class CuckooFilter:
    """Says of each hash it holds that it may be there; of others, rarely (about 8 / 65,536).

    A filter that could not take an insertion is `open`: it says so of every hash, so that nothing is lost.
    """

    def __init__(self, keys: int = 0):
        self.buckets = 1 << max(1, (max(keys, 1) * 5 // 16).bit_length())
        self.slots = np.zeros((self.buckets, 4), np.uint16)
        self.open = False

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = np.maximum(hashes >> _U(48), _U(1))
        first = hashes & _U(self.buckets - 1)
        return prints.astype(np.uint16), first, first ^ (mix(prints, 0xC0C0) & _U(self.buckets - 1))

    def _put(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put prints in free slots of their buckets; the places of those for which none was left."""
        order = np.argsort(at, kind="stable")
        rank = _rank(at[order])
        taken = self.slots[at[order]] != 0
        fits = rank < 4 - taken.sum(axis=1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, 3)]
        self.slots[at[order][fits], slot[fits]] = prints[order][fits]
        return np.sort(order[~fits])

    def insert(self, hashes: np.ndarray) -> None:
        """All hashes side by side: free slots first, then each round one print a bucket takes another's slot."""
        prints, one, two = self._places(hashes)
        left = self._put(prints, one)
        prints, at = prints[left], two[left]
        for kick in range(_KICKS):
            left = self._put(prints, at)
            if not len(left):
                return
            prints, at = prints[left].copy(), at[left].copy()
            first = np.unique(at, return_index=True)[1]
            out = self.slots[at[first], kick & 3].copy()
            self.slots[at[first], kick & 3] = prints[first]
            prints[first] = out
            at = at ^ (mix(prints.astype(_U), 0xC0C0) & _U(self.buckets - 1))
        self.open = True

    def _take(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Empty one slot for each print that its bucket holds; the places of those that it doesn't."""
        order = np.lexsort((prints, at))
        rank = _rank(at[order] << _U(16) | prints[order])
        here = self.slots[at[order]] == prints[order][:, None]
        fits = rank < here.sum(axis=1)
        slot = np.argsort(~here, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, 3)]
        self.slots[at[order][fits], slot[fits]] = 0
        return np.sort(order[~fits])

    def delete(self, hashes: np.ndarray) -> None:
        """Hashes that were inserted before, each as often at most."""
        prints, one, two = self._places(hashes)
        left = self._take(prints, one)
        self._take(prints[left], two[left])

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if self.open:
            return np.ones(len(hashes), bool)
        prints, one, two = self._places(hashes)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return b"" if self.open else self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls()
        out.open = not data
        out.slots = np.frombuffer(data, np.uint16).reshape(-1, 4).copy() if data else out.slots
        out.buckets = len(out.slots)
        return out


def _rank(x: np.ndarray) -> np.ndarray:
    """The number of each value among its equals; equal values stand side by side."""
    lead = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
    return np.arange(len(x)) - np.repeat(lead, np.diff(np.append(lead, len(x))))
