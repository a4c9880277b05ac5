"""Files to tables.  Paths go to Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.operators.extract import split_lines
from clausemill.sources.decoders import text_pages
from clausemill.sources.writers import BUCKET, bucket_of


def stem_of(path):
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no, raw."""
    files = spark.read.text(path, wholetext=True).select(stem_of(F.input_file_name()).alias("stem"), F.col("value").alias("text"))
    return split_lines(files).select("stem", F.col("line_no").cast("long").alias("line_no"), "raw")


def read_pages(spark: SparkSession, path: str, decoder: Callable[[bytes], list] = text_pages, pattern: str = "*") -> DataFrame:
    """stem, page_no (from 1), text, file_hash, n_images: one row per page that the decoder gives, as text or as (text, images on it).

    A decoder for PDF is the caller's.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = files.select(stem_of(F.col("path")).alias("stem"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("file_hash"), "content")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for s, h, c in zip(pdf["stem"], pdf["file_hash"], pdf["content"], strict=True):
                for k, page in enumerate(decoder(bytes(c)), start=1):
                    text, images = (page, 0) if isinstance(page, str) else page
                    rows.append((s, k, text.strip(), h, images))
            yield pd.DataFrame(rows, columns=["stem", "page_no", "text", "file_hash", "n_images"])

    return files.mapInPandas(run, f"{schemas.PAGES}, file_hash string, n_images int")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, under a schema, with its stem."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("stem", stem_of(F.input_file_name()))


def read_corpus(spark: SparkSession, path: str, schema: str, stem: str | None = None) -> DataFrame:
    """A table of write_step(); one stem prunes the other buckets before a file is opened."""
    table = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)
    if stem is not None:
        table = table.filter((F.col(BUCKET) == bucket_of(F.lit(stem))) & (F.col("stem") == stem))
    return table.drop(BUCKET)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOPICS).json(path, multiLine=True)


def search_stories(topics: DataFrame, client: Callable[[dict], list[dict]]) -> DataFrame:
    """topic, part, text: what a client answers to each topic, asked on the executors; a failed call gives a row of error text."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for topic in pdf.to_dict("records"):
                try:
                    rows += [(topic["name"], k, x.get("text")) for k, x in enumerate(client(topic))]
                except Exception as error:  # noqa: BLE001  a topic that fails has no stories
                    rows.append((topic["name"], 0, f"error: {error}"))
            yield pd.DataFrame(rows, columns=["topic", "part", "text"])

    return topics.mapInPandas(run, "topic string, part int, text string")


def fetch_pages(urls: DataFrame, fetcher: Callable[[str], str | None]) -> DataFrame:
    """url, html: each different URL fetched once; null where the fetcher fails."""

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            out = []
            for url in pdf["url"]:
                try:
                    out.append(fetcher(url))
                except Exception:  # noqa: BLE001  a page that fails is null
                    out.append(None)
            pdf["html"] = out
            yield pdf[["url", "html"]]

    return urls.select("url").distinct().mapInPandas(run, "url string, html string")


_LEDGER = "url string, attempt int, html string, error string"


def fetched(spark: SparkSession, ledger: str) -> DataFrame:
    """url, attempt, html, error: the last attempt of each URL that a ledger has."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/part-*"))
    if not there:
        return spark.createDataFrame([], _LEDGER)
    last = spark.read.schema(_LEDGER).parquet(ledger).groupBy("url").agg(F.max_by(F.struct("attempt", "html", "error"), F.struct(F.col("html").isNotNull(), F.col("attempt"))).alias("x"))
    return last.select("url", "x.attempt", "x.html", "x.error")


def fetch_with_ledger(urls: DataFrame, fetcher: Callable[[str], str | None], ledger: str, attempts: int = 3, per_task: int = 16) -> DataFrame:
    """url, attempt, html, error of the URLs given, each asked until it answers, `attempts` times at most, over all calls with this ledger.

    The ledger is a table that grows: each task writes what it was told when it ends, and that stays if the job fails later or an executor is lost, so
    at most the `per_task` URLs of a task under way are asked again.  A call that failed, or one with more URLs, goes on from there.
    """
    spark = urls.sparkSession
    wanted = urls.select("url").filter("url IS NOT NULL").distinct()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for url, attempt in zip(pdf["url"], pdf["attempt"], strict=True):
                try:
                    html = fetcher(url)
                    rows.append((url, attempt, html, None if html is not None else "no answer"))
                except Exception as error:  # noqa: BLE001  an attempt that fails is recorded
                    rows.append((url, attempt, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["url", "attempt", "html", "error"])

    for _ in range(attempts):
        before = fetched(spark, ledger).select("url", F.col("attempt").alias("tried"), F.col("html").isNotNull().alias("done"))
        open_ = wanted.join(before, "url", "left").filter(f"NOT coalesce(done, false) AND coalesce(tried, 0) < {attempts}").select("url", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))
        n = open_.count()
        if not n:
            break
        asked = open_.repartition(-(-n // per_task)).mapInPandas(run, _LEDGER)
        asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    return wanted.join(fetched(spark, ledger), "url", "left")


def list_documents(spark: SparkSession, inputs: str, metas: DataFrame | None = None) -> DataFrame:
    """stem, file_name, processed: PDF files in a folder (any case), and whether an index has their stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(inputs).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    files = files.withColumn("stem", stem_of(F.col("file_name")))
    if metas is None:
        return files.withColumn("processed", F.lit(False))
    done = metas.select("stem").distinct().withColumn("__done", F.lit(True))
    return files.join(done, "stem", "left").select("stem", "file_name", F.coalesce("__done", F.lit(False)).alias("processed"))


def newest(rows: DataFrame, value: str, when: str) -> DataFrame:
    """One row: the value with the largest time."""
    return rows.agg(F.max_by(value, when).alias(value))


def safe_name(name: str) -> str:
    """A file name that stays inside its folder; anything else is an error."""
    if not name or name != name.rsplit("/", 1)[-1] or "\\" in name or name in (".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    return name
