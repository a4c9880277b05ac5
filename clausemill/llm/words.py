"""Columnar word streams: Arrow batches of whole texts to flat NumPy arrays, a few MB at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_U = np.uint64


def _give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and share an executor's memory."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, as batches whose texts take about `budget` bytes; a longer text comes alone."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 16)
        start, done = 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, done + budget, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
        _give_back()


class Words:
    """Words of some texts.  A word is a run of characters other than ASCII white space; a null text has none.

    flat: the words; counts: how many each text has; owner: the text of each word; first: where each text begins.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        sizes = np.diff(parts.offsets.to_numpy())
        flat, owner = parts.flatten(), np.repeat(np.arange(len(texts)), sizes)
        real = pc.greater(pc.binary_length(flat), 0)
        if pc.all(real).as_py() is False:
            flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
        self.flat, self.owner = flat, owner
        self.counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def __len__(self) -> int:
        return len(self.owner)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number in the list of different words, and that list."""
        coded = self.flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        codes, different = self.codes()
        table = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in different.to_pylist()), dtype=_U, count=len(different))
        return table[codes] if len(table) else np.empty(0, _U)

    def kept(self, keep: np.ndarray) -> pa.Array:
        """Per text, the words for which keep is true, joined by one space."""
        sizes = np.bincount(self.owner[keep], minlength=len(self.counts))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.flat.filter(pa.array(keep))), " ")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all bits."""
    x = x ^ _U(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(x: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `width` neighbours: doubled from shorter runs, the last step overlapping."""
    if len(x) < width:
        return x[:0]
    reach, have = 1, mix(x, salt)
    while reach * 2 <= width:
        n = len(have) - reach
        have, reach = _pair(have[:n], have[reach:]), reach * 2
    if reach < width:
        n = len(x) - width + 1
        have = _pair(have[:n], have[width - reach : width - reach + n])
    return have


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _U(0x9E3779B97F4A7C15) + b) ^ (b >> _U(29))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    if len(x) < width:
        return x[:0]
    reach, have = 1, x
    while reach * 2 <= width:
        have, reach = np.minimum(have[:-reach], have[reach:]), reach * 2
    n = len(x) - width + 1
    return np.minimum(have[:n], have[width - reach : width - reach + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def majority(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For groups of 64-bit words that follow each other, the bits that are set in over half of them; empty groups give zero."""
    out, some = np.zeros(len(sizes), _U), np.flatnonzero(sizes)
    if not len(some):
        return out
    begin = (np.cumsum(sizes) - sizes)[some]
    chunks = (sizes[some] + 0xFFFE) // 0xFFFF  # sums of four bits side by side, each of 16 bits
    owner = np.repeat(np.arange(len(some)), chunks)
    lead = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * 0xFFFF
    sums = np.zeros((len(some), 64), np.int64)
    for k in range(16):
        lanes = np.add.reduceat((x >> _U(k)) & _U(0x0001000100010001), lead)
        for j in range(4):
            np.add.at(sums[:, k + 16 * j], owner, ((lanes >> _U(16 * j)) & _U(0xFFFF)).astype(np.int64))
    out[some] = np.packbits(sums * 2 > sizes[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out
