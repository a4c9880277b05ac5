"""Intermediate tables in the folder that all executors share: they end a lineage, and what is built once is read many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_kept: dict[tuple, tuple[DataFrame, ...]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), a local one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="clausemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends, or by release()."""
    path = f"{shared_dir(spark)}/clausemill/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str = "part", even: bool = True, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that its lineage ends there.

    The folder outlives lost executors.  Tables are dropped when the driver ends, or by release().  Rows are dealt out
    anew to files of Spark's advisory size; even=False leaves that out for tables as large as the input.  by: folders by this column.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    writer = (df.hint("rebalance") if even else df).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Tables of settle() that make() gives, made once in a session for the files of `inputs` as they are (paths, sizes, times).

    What many questions read, such as an index or a graph, is then built by the first.  Tables dropped since are made anew.
    """
    state = []
    for path in inputs:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            x = files.next()
            state.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    key = (id(spark), name, tuple(sorted(state)))
    if key not in _kept or not all(_is_there(spark, t._written_at) for t in _kept[key]):
        _kept[key] = make()
    return _kept[key]


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop(table: DataFrame) -> None:
    """Delete a table of settle() that nothing needs any more."""
    item = next((x for x in _written if x[1] == getattr(table, "_written_at", None)), None)
    if item is not None:
        _delete(item)


def _delete(item: tuple[SparkSession, str]) -> None:
    path = item[0]._jvm.org.apache.hadoop.fs.Path(item[1])
    path.getFileSystem(item[0]._jsc.hadoopConfiguration()).delete(path, True)
    _written.remove(item)


def release(spark: SparkSession, keep: int = 0, stored: bool = True) -> None:
    """Delete the tables written in this session, but for the first `keep`; stored: those of kept() too."""
    spared = set() if stored else {t._written_at for tables in _kept.values() for t in tables}
    for item in [x for x in _written if x[0] is spark][keep:]:
        if item[1] not in spared:
            _delete(item)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        if spark.sparkContext._jsc is not None and spark.getActiveSession() is not None:
            release(spark)
