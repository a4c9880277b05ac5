"""Removal of word passages that occur more than once in a corpus.

A window is `width` consecutive words of one document.  Every word under a window whose word sequence also starts
anywhere else (same document included) goes; windows are judged on the input.

1. Sketch.  Each window is known by its anchor: the least hash among its runs of `width - 15` words, with its
   position, so equal windows have equal anchors and a window occurs at most as often as its anchor's run.  Every task
   adds its anchors to a count-min sketch (two rows of saturating cells); the sketches of all tasks are summed block by
   block.  A cell can only overestimate, so no repeated window is missed.
2. Exact pass.  Windows whose estimate is two or more go to a shuffle keyed by 96 bits of window hash (64 + 32, from
   independent chains) where they are counted exactly.  Windows found twice within a slice of a task are settled
   there; of such a group one row goes on, and later slices of the task send none for it (up to `_TOLD` windows are
   remembered), so a passage held by a third of all rows is sent once for each task.
3. Positions come back per document, and words are dropped there.

The sketch is the only broadcast.  Its size follows the input up to `max_cells` cells for each row, one bit each when
sent; beyond that more windows pass to the exact step, and the result stays the same.

Defined cases: null or empty text has no words (kept text ''); a text shorter than a window stays; rows that repeat,
or that share an id or have none, count as separate documents, told apart by 96 bits of their id and text; null ids are kept as null; columns besides id and text play no part.
Texts longer than 2^20 words are cut into overlapping pieces that hold every window once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.shared import partitions, small_batches, text_bytes
from clausemill.llm.words import Words, mix, runs, signed, slices, sliding_min

_U = np.uint64
_PIECE = 1 << 20
_BLOCK = 1 << 20
_TOLD = 1 << 20
_SALTS = (0x51ED270B, 0x2545F491)


def _spread(width: int) -> int:
    """Runs looked at for a window's anchor."""
    return min(16, max(1, width // 2))


def _pieces(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Stretches of the word stream, each of at most _PIECE words, in which every window starts once."""
    at = 0
    while True:
        stop = min(n, at + _PIECE)
        yield at, stop
        if stop == n:
            return
        at = stop - width + 1


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window start, hash bits of its anchor above 20 bits of the anchor's place."""
    grams = runs(hashes, width - _spread(width) + 1)
    placed = (grams & ~_U(_PIECE - 1)) | np.arange(len(grams), dtype=_U)
    return sliding_min(placed, _spread(width))


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(anchors >> _U(20), _SALTS[row]) & _U(cells - 1)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, cells: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        for row in range(2):
            found, counts = np.unique(_cells(keys, row, cells), return_counts=True)
            cuts = np.searchsorted(found, np.arange(0, cells + _BLOCK, _BLOCK, dtype=_U))
            for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    low, many = (found[a:b] & _U(_BLOCK - 1)).astype(np.uint32), counts[a:b] > 1
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "one": pa.array([low[~many].tobytes()]), "more": pa.array([low[many].tobytes()])})
        held.clear()

    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        hashes = words.hashes()
        for a, b in _pieces(len(words), width):
            anchors = _anchors(hashes[a:b], width)
            n = len(anchors)
            anchors = anchors[words.owner[a : a + n] == words.owner[a + width - 1 : a + width - 1 + n]]
            if len(anchors):
                held.append(anchors[np.concatenate([[True], anchors[1:] != anchors[:-1]])])
        if sum(map(len, held)) > 1_000_000:
            yield from flush()
    if held:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' cells, saturating at two; of the sum, the bit 'two or more' goes on."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for x in batch.to_pylist():
            cell = sums.setdefault((x["row"], x["block"]), np.zeros(_BLOCK, np.uint8))
            one, more = np.frombuffer(x["one"], np.uint32), np.frombuffer(x["more"], np.uint32)
            cell[one] = np.minimum(cell[one] + 1, 2)
            cell[more] = 2
    for (row, block), cell in sums.items():
        yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(cell > 1, bitorder="little").tobytes()])})


def _repeated(sketch: list[np.ndarray], anchors: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate of a window's count is two or more."""
    out = np.ones(len(anchors), bool)
    for row, bits in enumerate(sketch):
        at = _cells(anchors, row, cells)
        out &= (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
    return out


_ROWS = "id long, mark int, h1 long, h2 int, pos int, span int, kind byte"


def _candidates(batches: Iterator[pa.RecordBatch], width: int, cells: int, sketch) -> Iterator[pa.RecordBatch]:
    """Rows of windows estimated repeated.

    kind 0: not yet known to repeat; 1: known to repeat, and tells others; 2: known to repeat (a run of `span` starts).
    """
    told = np.empty(0, _U), np.empty(0, np.uint32)  # sorted: windows sent as kind 1, which need not be sent again
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        hashes, owner = words.hashes(), words.owner
        ids, marks = batch.column("id"), batch.column("mark")
        for a, b in _pieces(len(words), width):
            anchors = _anchors(hashes[a:b], width)
            n = len(anchors)
            whole = np.flatnonzero(owner[a : a + n] == owner[a + width - 1 : a + width - 1 + n])
            if not len(whole):
                continue
            turn = np.flatnonzero(np.concatenate([[True], anchors[whole[1:]] != anchors[whole[:-1]]]))
            hit = np.repeat(_repeated(sketch.value, anchors[whole[turn]], cells), np.diff(np.append(turn, len(whole))))
            at = whole[hit]
            if not len(at):
                continue
            del anchors, whole, turn, hit
            h1 = runs(hashes[a:b], width, 0xA5A5)[at]
            h2 = (runs(hashes[a:b], width, 0xC3C3C3)[at] >> _U(32)).astype(np.uint32)
            order = np.lexsort((at, h2, h1))
            s1, s2 = h1[order], h2[order]
            same = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
            lead, follow = np.append(True, ~same), np.append(False, same)
            shared = np.append(same, False) & lead
            if len(told[0]):
                place = np.minimum(np.searchsorted(told[0], s1), len(told[0]) - 1)
                known = (told[0][place] == s1) & (told[1][place] == s2)
                lead, follow, shared = lead & ~known, follow | known, shared & ~known
            if len(told[0]) + shared.sum() <= _TOLD:
                both = np.concatenate([told[0], s1[shared]]), np.concatenate([told[1], s2[shared]])
                turn = np.argsort(both[0], kind="stable")
                told = both[0][turn], both[1][turn]
            kind = np.full(len(at), 0, np.int8)
            kind[order[shared]] = 1
            later = np.sort(at[order[follow]])
            apart = np.flatnonzero(np.concatenate([[True], (np.diff(later) > 1) | (owner[a + later[1:]] != owner[a + later[:-1]])])) if len(later) else later
            span = np.diff(np.append(apart, len(later)))
            stay = np.ones(len(at), bool)
            stay[order[follow]] = False
            place = np.concatenate([at[stay], later[apart]]) + a
            who = pa.array(owner[place])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": ids.take(who),
                    "mark": marks.take(who),
                    "h1": np.concatenate([signed(h1[stay]), signed(mix(place[stay.sum() :].astype(_U)))]),
                    "h2": np.concatenate([h2[stay].view(np.int32), np.zeros(len(apart), np.int32)]),
                    "pos": (place - words.first[owner[place]]).astype(np.int32),
                    "span": np.concatenate([np.ones(stay.sum(), np.int32), span.astype(np.int32)]),
                    "kind": np.concatenate([kind[stay], np.full(len(apart), 2, np.int8)]),
                }
            )


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        spots = batch.column("spots")
        edge = np.zeros(len(words) + 1, np.int32)
        sizes = np.diff(spots.offsets.to_numpy()) if len(spots) else np.empty(0, int)
        flat = spots.flatten().to_numpy(zero_copy_only=False)
        sizes = np.where(spots.is_null().to_numpy(zero_copy_only=False), 0, sizes)
        owner, place, end = np.repeat(np.arange(len(sizes)), sizes), flat >> 32, (flat >> 32) + (flat & 0xFFFFFFFF) + width - 1
        real = end <= words.counts[owner]  # else it is of a text that has the same marks
        begin = words.first[owner[real]]
        np.add.at(edge, begin + place[real], 1)
        np.add.at(edge, begin + end[real], -1)
        keep = np.cumsum(edge[:-1]) == 0
        removed = np.bincount(words.owner[~keep], minlength=len(words.counts)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_words": words.counts, "n_removed": removed, "kept_text": words.kept(keep)})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, max_cells: int = 1 << 29) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_text (see the module for the method and edge cases)."""
    if width < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = base.withColumns({"doc": F.xxhash64("id", "text"), "mark": F.hash("text", "id")})
    expected = text_bytes(base, "text") // 6 // (_spread(width) + 1) * 2 + 1
    cells = 1 << min(max(max_cells, _BLOCK).bit_length() - 1, max(20, (expected * 4 - 1).bit_length()))
    merged = base.select("text").mapInArrow(lambda it: _sketch(it, width, cells), "row int, block int, one binary, more binary").repartition(partitions(spark), "row", "block").mapInArrow(_merge, "row int, block int, bits binary")
    bits = [np.zeros(cells >> 3, np.uint8) for _ in range(2)]
    for x in merged.collect():  # at most 2 x cells / 8 bytes
        at = x["block"] * (_BLOCK >> 3)
        bits[x["row"]][at : at + (_BLOCK >> 3)] = np.frombuffer(x["bits"], np.uint8)
    sketch = spark.sparkContext.broadcast(bits)
    found = (
        marked.select(F.col("doc").alias("id"), "mark", "text").mapInArrow(lambda it: _candidates(it, width, cells, sketch), _ROWS)
        .withColumn("times", F.count(F.when(F.col("kind") < 2, 1)).over(Window.partitionBy("h1", "h2")))
        .filter("times > 1 OR kind > 0")
        .groupBy("id", "mark")
        .agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32) + F.col("span")).alias("spots"))
    )
    d, s = marked.alias("d"), found.hint("shuffle_hash").alias("s")
    joined = d.join(s, (F.col("d.doc") == F.col("s.id")) & (F.col("d.mark") == F.col("s.mark")), "left").select("d.id", "d.text", "s.spots")
    return joined.mapInArrow(lambda it: _remove(it, width), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
