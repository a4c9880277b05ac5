"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. quality rules: documents that fail them go;
2. line dedup: repeated lines go from the texts, n_chars follows, all documents stay;
3. near duplicates: documents whose sets of 5-word shingles are at least 0.8 similar; of each group the smallest id stays;
4. benchmark decontamination: documents that hold an item of the benchmark go;
5. SentencePiece: texts become ids; columns doc_id, lang, source, n_chars, n_pieces, token_ids, lossless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm.decontaminate import drop_contaminated
from clausemill.llm.line_dedup import drop_lines
from clausemill.llm.near_texts import keep_one_text
from clausemill.llm.quality_rules import keep_good
from clausemill.llm.sentencepiece_codec import encode
from clausemill.llm.shared import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_text(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("sentencepiece", pieces)]
#: Sampled segmentations and fitted fences have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each but the last written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{k}", even=False)
    return docs
