"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.functions.text import STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: SQL of the index's words of a text column.
def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({quoted(STOPWORDS)}))"
