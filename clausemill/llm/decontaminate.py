"""Benchmark items found in documents, by fingerprints of item-sized windows.

Words are compared with A-Z lower-cased.  An item of n words is compared with the windows of n words of every document
(a document with fewer words is one window), as multisets of 5-word shingles (of n words, if n is less than 5):

1. A window can only reach similarity s if at least 2s / (1 + s) of the mean shingle count is shared, so windows whose
   shingles are not that often shingles of the benchmark are left out.  This loses nothing.
2. Windows and items have 256-bit SimHashes of their shingles; a shingle that comes again counts as another one, so that
   multisets are compared and no word outweighs the rest.
3. Items within `radius` bits of a window are found through an index of 16 blocks of 16 bits: at 79 bits or less, at least
   three blocks differ in five bits or less (else 14 blocks would differ in six).  Neighbours are looked for among the values
   that a block has, or among the patterns of five flips, whichever are fewer.  This finds every fingerprint within the radius.
4. Those are verified: sum of least counts over sum of largest counts of shingles >= `least`.

A bit differs with a probability of arccos(2s / (1 + s)) / pi about, 0.15 at 0.8.  Exactly at 0.8, by the binomial sums
over all sizes up to 140 shingles, a window lies beyond 79 bits with a probability below 2e-9, and below 2e-6 for four
against five shingles; unlike texts lie 128 bits apart.

Items are held in memory in blocks of at most `block_bytes` of text, one pass over the documents for each block, so a
benchmark of any size is served.

Defined cases: null or empty texts and items have no words and match nothing; null ids are kept; items with equal
texts match each on its own; repeated rows each give rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.shared import small_batches
from clausemill.llm.words import Words, majority, mix, runs, slices

_U = np.uint64
_RADIUS, _BLOCKS, _FLIPS, _LEAST_BLOCKS = 79, 16, 5, 3


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _numbered(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shingles of groups that follow each other, each told apart from its earlier equals in the group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((shingles, group))
    lead = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (shingles[order][1:] != shingles[order][:-1]))) if len(order) else order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(lead, np.diff(np.append(lead, len(order))))
    return mix(shingles + rank.astype(_U) * _U(0x9E3779B97F4A7C15))


def _prints(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """256-bit SimHashes, as four words a group."""
    return np.stack([majority(mix(keys, 0x51 + k), sizes) for k in range(4)], axis=1)


class HammingIndex:
    """Fingerprints by 16 blocks; near() gives each within `radius` bits of a query (79 at most)."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        for column in prints.view(np.uint16).T:
            order = np.argsort(column, kind="stable")
            values, begin = np.unique(column[order], return_index=True)
            self.blocks.append((values, np.append(begin, len(order)), order))
        self.masks = np.array([sum(1 << b for b in bits) for n in range(_FLIPS + 1) for bits in combinations(range(16), n)], np.uint16)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, fingerprint and differing bits of all pairs within the radius."""
        found, step = [], max(1, 1_000_000 // max(1, min(len(self.masks), len(self.prints))))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            pairs = np.concatenate([self._block(part.view(np.uint16)[:, k], *self.blocks[k]) for k in range(_BLOCKS)])
            pairs, times = np.unique(pairs, return_counts=True)
            q, j = np.divmod(pairs[times >= _LEAST_BLOCKS], len(self.prints))
            bits = np.bitwise_count(part[q] ^ self.prints[j]).sum(axis=1, dtype=np.int64)
            fine = bits <= self.radius
            found.append((q[fine] + at, j[fine], bits[fine]))
        return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))

    def _block(self, query: np.ndarray, values: np.ndarray, begin: np.ndarray, order: np.ndarray) -> np.ndarray:
        """query x all + fingerprint, of those whose block is near."""
        if len(values) <= len(self.masks):
            q, v = np.nonzero(np.bitwise_count(query[:, None] ^ values) <= _FLIPS)
        else:
            wanted = query[:, None] ^ self.masks
            place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            q, m = np.nonzero(values[place] == wanted)
            v = place[q, m]
        sizes = begin[v + 1] - begin[v]
        return np.repeat(q, sizes) * len(self.prints) + order[_ranges(begin[v], sizes)]


class ItemIndex:
    """Items of one block of a benchmark, by shingle width and length: shingles, fingerprints and their index."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int, least: float):
        if not 0 <= radius <= _RADIUS:
            raise ValueError(f"the index finds fingerprints within {_RADIUS} bits")
        self.least = least
        words = Words(pa.array([x for _, x in items], pa.string()), lower=True)
        hashes, self.ids = words.hashes(), np.array([k for k, _ in items], object)
        self.groups: dict[int, dict] = {}
        for k in sorted({min(width, int(n)) for n in words.counts if n}):
            own = runs(hashes, k, 0xD0 + k)
            mine = np.flatnonzero((np.minimum(words.counts, width) == k) & (words.counts >= k))
            known = np.unique(own[_ranges(words.first[mine], words.counts[mine] - k + 1)])
            sieve = np.zeros(1 << 22, bool)
            sieve[known >> _U(42)] = True
            lengths = {}
            for length in np.unique(words.counts[mine]).tolist():
                rows = mine[words.counts[mine] == length]
                sizes = np.full(len(rows), length - k + 1)
                keys = _numbered(own[_ranges(words.first[rows], sizes)], sizes)
                member = np.sort(mix(keys ^ mix(np.repeat(np.arange(len(rows), dtype=_U), sizes), 0x1D)))
                lengths[length] = (rows, HammingIndex(_prints(keys, sizes), radius), member)
            self.groups[k] = {"lengths": lengths, "known": known, "sieve": sieve}

    def search(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """row, item, first word, words, bits, similarity: the most similar window of each row and item, the first of equals."""
        words = Words(texts, lower=True)
        hashes, found = words.hashes(), []
        for k, group in self.groups.items():
            shingles = runs(hashes, k, 0xD0 + k)
            n = len(shingles)
            whole = words.owner[:n] == words.owner[k - 1 : k - 1 + n] if n else np.empty(0, bool)
            near = np.flatnonzero(group["sieve"][shingles >> _U(42)] & whole)
            at = np.minimum(np.searchsorted(group["known"], shingles[near]), len(group["known"]) - 1)
            hit = np.zeros(n + 1, np.int64)
            hit[near[group["known"][at] == shingles[near]]] = 1
            upto = np.append(0, np.cumsum(hit[:-1]))
            full = np.maximum(words.counts - k + 1, 0)
            total = upto[np.minimum(words.first + full, n)] - upto[np.minimum(words.first, n)]
            for length, items in group["lengths"].items():
                want = length - k + 1
                has = np.minimum(want, full)
                need = np.ceil(self.least / (1 + self.least) * (want + has) - 1e-9).astype(np.int64)
                rows = np.flatnonzero((full > 0) & (total >= need))
                starts = _ranges(words.first[rows], full[rows] - has[rows] + 1)
                row = np.repeat(rows, full[rows] - has[rows] + 1)
                fine = upto[starts + has[row]] - upto[starts] >= need[row]
                starts, row = starts[fine], row[fine]
                step = max(1, 500_000 // want)
                for piece in range(0, len(starts), step):
                    found.append(self._verified(items, length, want, starts[piece : piece + step], row[piece : piece + step], has, shingles, words))
        names = ("row", "item", "first", "words", "bits", "similarity")
        columns = [np.concatenate([x[k] for x in found]) if found else np.empty(0) for k in range(6)]
        order = np.lexsort((columns[2], -columns[5], columns[1], columns[0]))
        lead = np.append(True, (np.diff(columns[0][order]) != 0) | (np.diff(columns[1][order]) != 0)) if len(order) else np.empty(0, bool)
        return {x: c[order][lead] for x, c in zip(names, columns, strict=True)}

    def _verified(self, items: tuple, length: int, want: int, starts: np.ndarray, row: np.ndarray, has: np.ndarray, shingles: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
        numbers, index, member = items
        sizes = has[row]
        keys = _numbered(shingles[_ranges(starts, sizes)], sizes)
        w, j, bits = index.near(_prints(keys, sizes))
        begin = (np.cumsum(sizes) - sizes)[w]
        own = mix(keys[_ranges(begin, sizes[w])] ^ mix(np.repeat(j.astype(_U), sizes[w]), 0x1D))
        held = member[np.minimum(np.searchsorted(member, own), len(member) - 1)] == own
        shared = np.add.reduceat(held, np.cumsum(sizes[w]) - sizes[w], dtype=np.int64) if len(w) else np.empty(0, np.int64)
        similarity = shared / (sizes[w] + want - shared)
        fine = similarity >= self.least
        w, j = w[fine], j[fine]
        return row[w], numbers[j], starts[w] - words.first[row[w]], np.minimum(length, words.counts[row[w]]), bits[fine], similarity[fine]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for x in items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL").toLocalIterator():
        if block and size + len(x["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((x["id"], x["text"]))
        size += len(x["text"])
    yield block


_FOUND = "item_id long, first_word long, n_words long, differing_bits int, similarity double"


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8, radius: int = _RADIUS, block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document row and item that it holds: id_col, item_id, and its most similar window."""
    small_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def found(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                x = index.value.search(batch.column("text"))
                ids = batch.column("id").take(pa.array(x["row"].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(index.value.ids[x["item"].astype(np.int64)].tolist(), pa.int64()), *(pa.array(x[c].astype(np.int64)) for c in ("first", "words")), pa.array(x["bits"].astype(np.int32)), pa.array(x["similarity"].astype(np.float64))], names=["id", "item_id", "first_word", "n_words", "differing_bits", "similarity"])

        return inner.mapInArrow(run, f"id long, {_FOUND}")

    context = docs.sparkSession.sparkContext
    parts = [found(context.broadcast(ItemIndex(block, width, radius, least))) for block in _item_blocks(items, item_id, item_text, block_bytes)]
    return reduce(DataFrame.union, parts).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8, radius: int = _RADIUS, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, with their columns, that hold no item.  No text is shuffled."""
    small_batches(docs.sparkSession)
    at, out = docs.columns.index(text_col), docs
    for block in _item_blocks(items, item_id, item_text, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, width, radius, least))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, f"c{at}"):
                stay = np.ones(len(batch), bool)
                stay[index.value.search(batch.column(at))["row"].astype(np.int64)] = False
                yield batch.filter(pa.array(stay))

        named = out.toDF(*(f"c{k}" for k in range(len(docs.columns))))
        out = named.mapInArrow(run, T.StructType(named.schema.fields)).toDF(*docs.columns)
    return out
