"""Exact nearest vectors by cells: vectors near each other lie together, and a bound says which cells a question can leave out.

A cell is a vector of the corpus (its centre), the vectors nearest to it, and the largest angle between them and the centre.  Angles
obey the triangle inequality, so no vector of a cell is nearer to a question than the centre's angle less the radius.  The cells with the best
bounds are read first; their k-th best score is a floor, and only cells whose bound reaches it are read at all.

Centres are at most `most` vectors, taken by a hash of their key (the sample decides what a question costs, never what it finds).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import values as v
from clausemill.tables import settle

_ROUNDED = 1e-4


@dataclass(frozen=True)
class Cells:
    """centres: cell, centre, radius (angle), n.  vectors: stem, ord, vector, cell, in order of cell."""

    centres: DataFrame
    vectors: DataFrame


def build(vectors: DataFrame, vector: str = "vector", stem: str = "stem", order: str = "ord", most: int = 2048) -> Cells:
    """Cells of unit vectors: about the square root of their number, at most `most`.  Null vectors are in none."""
    rows = vectors.select(F.col(stem).alias("stem"), F.col(order).alias("ord"), F.col(vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    n = rows.count()
    wanted = max(1, min(most, math.isqrt(n)))
    drawn = F.pmod(F.xxhash64("stem", "ord"), F.lit(1 << 30)) < F.lit(int((wanted * 1.5 + 20) / max(n, 1) * (1 << 30)) + 1)
    centres = [r["vector"] for r in rows.filter(drawn).orderBy(F.xxhash64("ord", "stem")).limit(wanted).select("vector").collect()]
    if not centres and n:
        centres = [rows.first()["vector"]]
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most `most` vectors

    def nearest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        points = np.array(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = np.array(part.column("vector").to_pylist()).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((x @ points.T).argmax(axis=1).astype(np.int32))], names=["stem", "ord", "vector", "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(nearest, f"{kinds}, cell int") if n else rows.withColumn("cell", F.lit(0))
    placed = settle(placed.repartitionByRange("cell", "stem", "ord").sortWithinPartitions("cell", "stem", "ord"), "cells", even=False)
    points = rows.sparkSession.createDataFrame([(k, x) for k, x in enumerate(centres)], "cell int, centre array<double>")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v.dot(F.col("vector"), F.col("centre")))))
    radius = placed.join(F.broadcast(points), "cell").groupBy("cell").agg(F.max(angle).alias("radius"), F.count("*").alias("n"))
    return Cells(settle(points.join(radius, "cell"), "centres"), placed)


@dataclass(frozen=True)
class Plan:
    """The cells a question reads, the floor, and how many vectors that is out of how many."""

    cells: list[int]
    floor: float
    read: int
    of: int


def _scored(cells: Cells, chosen: list[int], query: list[float]) -> DataFrame:
    """Cell numbers are literals, which the scan pushes down to the files' statistics."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return cells.vectors.filter(F.col("cell").isin(chosen)).select("stem", "ord", v.dot(F.col("vector"), q).alias("score"))


def plan(cells: Cells, query: list[float], k: int) -> Plan:
    """query: a unit vector."""
    bounds = []
    for c in cells.centres.collect():  # a row for each cell
        away = math.acos(max(-1.0, min(1.0, math.fsum(a * b for a, b in zip(c["centre"], query, strict=True)))))
        bounds.append((math.cos(max(0.0, away - c["radius"] - 1e-9)), c["n"], c["cell"]))
    bounds.sort(reverse=True)
    first, have = [], 0
    for _, n, cell in bounds:
        if have >= 4 * k and len(first) >= 2:
            break
        first.append(cell)
        have += n
    best = _scored(cells, first, query).orderBy(F.desc("score")).limit(k).collect() if first else []
    floor = max(0.0, best[-1]["score"] - 2 * _ROUNDED) if len(best) == k else 0.0
    chosen = [(cell, n) for bound, n, cell in bounds if bound >= floor]
    return Plan([c for c, _ in chosen], floor, sum(n for _, n in chosen), sum(n for _, n, _ in bounds))


def top_scores(cells: Cells, query: list[float], k: int) -> DataFrame:
    """stem, ord, score > 0: all vectors that may be among the best k."""
    return _scored(cells, plan(cells, query, k).cells, query).filter("score > 0")
