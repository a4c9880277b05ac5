"""Near duplicates by SimHash, joined on a grid of segment bit counts.

Fingerprint: words of the text with A-Z lower-cased, 3-word shingles (repeats included), XXH64 with seed 42 of each;
a bit is set if it is set in over half of them.  Fewer words: the whole sequence is one shingle; none: zero.

Links: a fingerprint becomes the vector of bit counts of its 2-bit segments.  The Manhattan distance of two vectors is
at most the Hamming distance of the fingerprints, so partners within two bits lie within two steps on the grid, and
two points two steps apart have a grid point between them, one step from each.  Each different fingerprint is sent to
its own point and to those one step away (49 on average); those that meet at a point are compared bit by bit.
What meets at a crowded point goes on as single fingerprints, and those link through the exact bit patterns one flip away
(two fingerprints at most two bits apart share one): 65 keys each, spread over all tasks, and never all pairs.

Components of linked fingerprints come from alternating stars, and each document takes the smallest id reachable.

Defined cases: null text has fingerprint zero, linked like any other; null ids get a row, and never name a component
unless it has no other id; repeated rows each get a row; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.shared import partitions, settle, small_batches
from clausemill.llm.words import Words, majority, mix, signed, slices

_U = np.uint64
_SEGMENTS = 32
_WEIGHTS = mix(np.arange(1, _SEGMENTS + 1, dtype=_U), 0x5EED) | _U(1)
_CROWD = 48


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    words = Words(texts, lower=True)
    n = len(words.counts)
    if not len(words):
        return np.zeros(n, _U)
    joined = words.kept(np.ones(len(words), bool))
    lens = pc.binary_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(lens + 1) - (lens + 1)
    start = joined.offsets.to_numpy()[words.owner] + run - run[words.first[words.owner]] if hasattr(joined, "offsets") else None
    if start is None:
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[: n + 1].astype(np.int64)
        start = offsets[words.owner] + run - run[words.first[words.owner]]
    end = start + lens
    head = np.flatnonzero(words.owner[: len(words) - size + 1] == words.owner[size - 1 :]) if len(words) >= size else np.empty(0, int)
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    begin = np.concatenate([start[head], start[words.first[few]]])
    stop = np.concatenate([end[head + size - 1], end[words.first[few] + words.counts[few] - 1]])
    owner = np.concatenate([words.owner[head], few])
    data, digest = memoryview(joined.buffers()[2]), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], 42) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), _U, len(begin))
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    return majority(hashes, np.bincount(owner, minlength=n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id (long), fp (long: the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": signed(_fingerprints(batch.column("text"), shingle))})

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, fp long")


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grid points of fingerprints: their own, and those one step away."""
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            fp = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False).view(_U)
            pairs = (fp[:, None] >> (_U(2) * np.arange(_SEGMENTS, dtype=_U))) & _U(3)
            counts = (pairs & _U(1)) + (pairs >> _U(1))
            home = (counts * _WEIGHTS).sum(axis=1, dtype=_U)
            down, up = np.nonzero(counts > 0), np.nonzero(counts < 2)
            keys = np.concatenate([home, home[down[0]] - _WEIGHTS[down[1]], home[up[0]] + _WEIGHTS[up[1]]])
            who = np.concatenate([fp, fp[down[0]], fp[up[0]]])
            yield pa.RecordBatch.from_pydict({"point": signed(mix(keys)), "fp": signed(who)})


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined until they have enough rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by point -> verified links (u, v) of fingerprints that meet, and the fingerprints of crowded points (v null).

    A batch's last point is carried on, but for one that is crowded already: that one is sent on as it comes.
    """
    points, fps, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

    def linked(points: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(points):
            return
        fp = fps.view(_U)
        lead = np.flatnonzero(np.append(True, points[1:] != points[:-1]))
        sizes = np.diff(np.append(lead, len(points)))
        group = np.repeat(np.arange(len(lead)), sizes)
        left, right = [np.empty(0, _U)], [np.empty(0, _U)]
        small = (sizes[group] <= _CROWD) & (points != crowded if crowded is not None else True)
        for step in range(1, int(min(sizes.max(), _CROWD))):
            at = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            at = at[_near(fp[at], fp[at + step], radius)]
            left.append(fp[at])
            right.append(fp[at + step])
        a, b, many = signed(np.concatenate(left)), signed(np.concatenate(right)), fps[~small]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        if pairs.size or len(many):
            yield pa.RecordBatch.from_pydict({"u": np.concatenate([pairs[0], many]), "v": pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(many), pa.int64())])})

    for batch in _together(batches, 100_000):
        points = np.concatenate([points, batch.column("point").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy()])
        cut = int(np.searchsorted(points, points[-1])) if len(points) else 0
        if len(points) - cut > _CROWD or len(points) and points[-1] == crowded:
            last, cut = points[-1], len(points)
        else:
            last = crowded
        yield from linked(points[:cut], fps[:cut])
        points, fps, crowded = points[cut:], fps[cut:], last
    yield from linked(points, fps)


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Different fingerprints in column fp, each once -> links (u, v) with 1 to `radius` differing bits.

    All links of sparse points; at crowded points, links enough to connect all that are linked.
    """
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    met = prints.select("fp").mapInArrow(_points, "point long, fp long").repartition(partitions(prints.sparkSession), "point").sortWithinPartitions("point")
    met = settle(met.mapInArrow(lambda it: _links(it, radius), "u long, v long"), "met")
    crowd = met.filter("v IS NULL").select("u").distinct()
    flips = F.array(F.col("u"), *(F.col("u").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))
    patterns = crowd.select("u", F.explode(flips).alias("pattern"))
    other = crowd.select(F.col("u").alias("pattern"), F.col("u").alias("v")) if radius == 1 else patterns.groupBy("pattern").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").select("pattern", "v")
    crossed = patterns.join(other, "pattern").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return met.filter("v IS NOT NULL").union(crossed).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id_col, fp (long), component_id (the smallest id reachable over links)."""
    printed = settle(fingerprints(docs, id_col, text_col, shingle), "prints")
    different = settle(printed.groupBy("fp").agg(F.min("id").alias("low")), "different")
    roots = components(near_links(different, radius))
    rooted = different.join(roots, different["fp"] == roots["u"], "left").select("fp", "low", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return printed.join(named, F.col("fp") == F.col("of"), "left").select(F.col("id").alias(id_col), "fp", "component_id")
