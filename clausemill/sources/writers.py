"""Tables to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.values import now_utc
from clausemill.tables import settle


#: Folders of a table by document: as many whatever the number of documents.
BUCKET, BUCKETS = "stem_bucket", 256


def bucket_of(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def write_step(df: DataFrame, path: str, by: str = "stem") -> None:
    """A step's table in folders by a hash of the document; only the documents written are replaced.

    The buckets that the documents fall in are written anew with what else they hold, so a table of any number of documents
    is a fixed number of folders, and a repeated write leaves it as it is.
    """
    spark = df.sparkSession
    new = settle(df.withColumn(BUCKET, bucket_of(F.col(by))), "step")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = F.broadcast(new.select(BUCKET).distinct())  # at most BUCKETS rows
        old = spark.read.schema(new.schema).parquet(path).join(touched, BUCKET, "left_semi").join(new.select(by).distinct(), by, "left_anti")
        new = settle(new.unionByName(old), "step")
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: the other columns as an object, nulls kept."""
    own = F.struct(*(c for c in df.columns if c not in keys))
    return df.select(*keys, F.to_json(own, {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str, by: str, text: str = "markdown") -> None:
    """One text column, a folder for each value of `by`."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def append_log(df: DataFrame, path: str) -> None:
    """stem, step, status, detail, and the time of writing."""
    df.select("stem", "step", "status", "detail", now_utc().alias("generated_at")).write.mode("append").parquet(path)
