"""Records and small helpers over the shared folder, and sizes taken from the session."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.tables import drop, own_folder, release, settle, shared_dir

__all__ = ["drop", "own_folder", "release", "settle", "shared_dir"]


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted, without files that begin with an underscore; nothing if it isn't there."""
    fs, where = _at(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(x for x in found if not x.startswith(("_", ".")))


def publish(spark: SparkSession, folder: str, name: str, record: dict) -> bool:
    """Write a record under a name that none has yet; False if another was first.

    The file is written aside and renamed without overwriting, which of several writers lets one win where the store
    renames files atomically (HDFS does; stores of objects need a committer that does).  Readers see whole records only.
    """
    fs, aside = _at(spark, f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps(record).encode())
    out.close()
    jvm, place = spark._jvm, _at(spark, f"{folder}/{name}")[1]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, place, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        if not fs.exists(place):
            raise
        return False
    finally:
        fs.delete(aside, False)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def record(spark: SparkSession, path: str) -> dict:
    """A published record."""
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def records(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Records published in a folder, in order of their names."""
    return {name: record(spark, f"{folder}/{name}") for name in names(spark, folder)}


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (of a few numbers), else to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's Arrow batches to `rows` rows, and Parquet's to a quarter: whole texts are long, and a batch is held several times over."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", rows // 4)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of UTF-8 in a column, over all rows: one scan that returns one number."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores, so that no column of the input is hidden by one of ours."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def once(make: Callable[[], object]) -> Callable[[], object]:
    """Value of make(), made at the first call in each process (an executor's Python worker)."""
    box: list[object] = []

    def get() -> object:
        if not box:
            box.append(make())
        return box[0]

    return get
