"""The graph as tables that answer by key: edges by their source, edges by their target, and nodes, in folders by a hash of the key.

A question has a few keys.  Their folders and the keys themselves are literals, so that of a stored graph only those folders are
opened, nothing is shuffled, and the work does not grow with the graph.  Beyond `MOST` keys the tables are joined instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, MOST = 64, 2000


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def by_key(df: DataFrame, key: str, *more: str) -> DataFrame:
    """df with its folder, in order of folder and key, dealt out by ranges of both and of `more`, so that a key with many rows is spread over tasks and files."""
    return df.withColumn("bucket", bucket_of(F.col(key))).repartitionByRange("bucket", key, *more).sortWithinPartitions("bucket", key)


def of_keys(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of a table of by_key() whose key is among those of `keys` (one column)."""
    keys = keys.toDF(key).filter(F.col(key).isNotNull()).distinct()
    found = keys.withColumn("b", bucket_of(F.col(key))).limit(MOST + 1).collect()
    if len(found) <= MOST:
        return table.filter(F.col("bucket").isin(sorted({r["b"] for r in found})) & F.col(key).isin(sorted(r[key] for r in found))).drop("bucket")
    return table.drop("bucket").join(keys, key, "left_semi")


@dataclass(frozen=True)
class Adjacency:
    """Tables with column bucket: nodes by id, and the edges twice."""

    nodes: DataFrame
    by_source: DataFrame
    by_target: DataFrame

    def edges_from(self, kind: str, sources: DataFrame) -> DataFrame:
        return of_keys(self.by_source, "source", sources).filter(F.col("type") == kind)

    def edges_to(self, kind: str, targets: DataFrame) -> DataFrame:
        return of_keys(self.by_target, "target", targets).filter(F.col("type") == kind)

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        return of_keys(self.nodes, "id", ids)


def store(nodes: DataFrame, edges: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> Adjacency:
    """keep(name, df): df written in folders by its column bucket, and read back."""
    return Adjacency(keep("nodes_by_id", by_key(nodes, "id")), keep("edges_by_source", by_key(edges, "source", "target")), keep("edges_by_target", by_key(edges, "target", "source")))
