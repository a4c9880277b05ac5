"""Token totals by source, language and tokenizer version, kept by signed deltas.

A change is one row: insert (n_tokens), delete (n_tokens), or revise (old_tokens, n_tokens) of a document's count under
one tokenizer version.  Each becomes signed numbers (documents, tokens), which add up in any order, so a batch is
aggregated before it is stored and totals are sums over batches.  A group with a third of all rows is one row per task
after the partial aggregation.

TokenRollup writes a batch's deltas in a new folder; they count from when a record of that folder is published under the
batch's name, which one of several writers can do (shared.publish).  A batch whose name is taken changes nothing, so a
retried, doubled or concurrent commit counts once.  compact() folds batches into one folder, under the next number, which one
writer gets; what counts is the last fold and the batches that it doesn't name.  Whether a name is taken is one look at the folder,
and only records of batches not yet folded are read.

Defined cases: null source, language or version are groups of their own; null counts are zero; null text has no
tokens; repeated change rows count each; an empty batch is committed and adds nothing; groups whose documents and tokens
all sum to zero are not returned; other columns play no part.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.shared import exists, names, once, publish, record, remove, small_batches
from clausemill.llm.words import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")


def count_tokens(docs: DataFrame, text_cols: list[str], ranks: str = RANKS) -> DataFrame:
    """All columns but text_cols, and for each of those its token count under a byte-pair vocabulary, as n_<k>."""
    small_batches(docs.sparkSession)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in docs.columns if c not in text_cols]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), *(F.col(f"`{c}`").alias(f"t{k}") for k, c in enumerate(text_cols)))
    fields = [f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)] + [f"n_{k} long" for k in range(len(text_cols))]

    def make() -> object:
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})

    encoding = once(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding().encode_ordinary
        for batch in slices(batches, "t0"):
            counts = [[len(encode(x)) if x else 0 for x in batch.column(f"t{k}").to_pylist()] for k in range(len(text_cols))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(x, pa.int64()) for x in counts)], names=[*(f"c{k}" for k in range(len(keep))), *(f"n_{k}" for k in range(len(text_cols)))])

    return inner.mapInArrow(run, ", ".join(fields)).toDF(*keep, *(f"n_{k}" for k in range(len(text_cols))))


def signed(changes: DataFrame) -> DataFrame:
    """source, lang, version, n_docs, n_tokens: what each change adds."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("op", F.lit("null")))))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old)
    return changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals in the folder `path`, which all executors share."""

    SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _live(self) -> tuple[list[str], list[str], list[str]]:
        """Folders that count, the batches in them, and the names of all folds."""
        folds = names(self.spark, f"{self.path}/folds")  # first, so that the batches of the last fold are among those listed next
        taken = names(self.spark, f"{self.path}/records")
        fold = record(self.spark, f"{self.path}/folds/{folds[-1]}") if folds else {"folder": None, "batches": []}
        within = set(fold["batches"])
        batches = [x.removeprefix("batch=") for x in taken]
        own = [record(self.spark, f"{self.path}/records/batch={x}")["folder"] for x in batches if x not in within]
        return ([fold["folder"]] if folds else []) + own, batches, folds

    def batches(self) -> list[str]:
        """Names of the batches committed so far."""
        return sorted(x.removeprefix("batch=") for x in names(self.spark, f"{self.path}/records"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and no change, if the name was committed before."""
        if not batch or any(x in batch for x in "\n/=:"):
            raise ValueError("a batch name is not empty and has no line end, '/', ':' or '='")
        if exists(self.spark, f"{self.path}/records/batch={batch}"):
            return False
        rows = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._put(rows, "records", f"batch={batch}")

    def _put(self, rows: DataFrame, kind: str, name: str, **more: list[str]) -> bool:
        folder = f"{self.path}/deltas/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        done = publish(self.spark, f"{self.path}/{kind}", name, {"folder": folder, **more})
        if not done:
            remove(self.spark, folder)
        return done

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches."""
        folders = self._live()[0]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*folders)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into one folder.  The record decides: before it the old folders count, after it the new one.

        Of several at once one gets the number, and the others leave no trace.  Records stay, so that no name can be taken again.
        """
        old, batches, folds = self._live()
        if len(old) > 1:
            rows = self.spark.read.schema(self.SCHEMA).parquet(*old).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            if self._put(rows, "folds", f"{len(folds):08d}", batches=batches):
                for folder in old:
                    remove(self.spark, folder)
