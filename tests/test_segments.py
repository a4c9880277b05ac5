"""Two-level running values read what they are made from once."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators.scan import running


def test_rows_are_made_once_and_equal_one_window_with_null_documents_too(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def stem(k):
        made.add(1)
        return None if k % 3 == 0 else f"d{k % 3}"

    df = spark.range(60).select(stem("id").alias("stem"), F.col("id").alias("ord"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    values = {"seen": ("last", F.col("v")), "total": ("sum", F.col("v"))}
    for inclusive in (True, False):
        want = sorted(running(df, ["stem"], "ord", values, inclusive).collect(), key=lambda r: r["ord"])
        made.value = 0
        got = running(df, ["stem"], "ord", values, inclusive, segment=4)
        assert sorted(got.collect(), key=lambda r: r["ord"]) == want
        assert made.value == 60
