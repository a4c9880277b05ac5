"""Operative units tagged by a classifier hook, under a contract that keeps every field in its vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import values as v
from clausemill.operators.catalog import ACTIONS, ESCAPE, MODALITIES, OBLIGATIONS, schema_rules, violations
from clausemill.operators.clauses import batch_ids
from clausemill.operators.structure import operative_units, trails

REPLY = "stem string, batch int, index int, reply_ord int, domain string, concept string, action string, object string, obligation_type string, mandatory_flag string, confidence_score string"
_FREE = ["domain", "concept", "action", "object", "obligation_type", "mandatory_flag", "confidence_score"]


def units(nodes: DataFrame, size: int = 20, max_chars: int = 800) -> DataFrame:
    """Operative units in batches, as the hook gets them: stem, ord, batch, index, trail, text."""
    x = operative_units(trails(nodes))
    return batch_ids(x, ["ord"], size).select("stem", "ord", "batch", "index", "trail", F.substring("text", 1, max_chars).alias("text"))


def ask(batches: DataFrame, classifier: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Replies of a classifier, one call for each batch; a call that fails leaves its units without replies."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("index")
        try:
            replies = classifier(pdf[["index", "trail", "text"]].to_dict("records"))
        except Exception:  # noqa: BLE001  the units of a failed batch stay unclassified
            replies = []
        rows = [(pdf["stem"].iloc[0], int(pdf["batch"].iloc[0]), int(x["index"]), k, *(None if x.get(c) is None else str(x[c]) for c in _FREE)) for k, x in enumerate(replies) if x.get("index") is not None]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY.split(", ")])

    return batches.groupBy("stem", "batch").applyInPandas(run, REPLY)


def contract(domain_labels: list[str]) -> dict:
    """What a classifier's reply must be, as a JSON schema."""
    text = {"type": ["string", "null"], "maxLength": 80}
    named = {"domain": domain_labels, "action": ACTIONS, "obligation_type": OBLIGATIONS, "mandatory_flag": MODALITIES}
    properties = {"index": {"type": "integer", "minimum": 0}, "concept": text, "object": text, "confidence_score": {"type": ["number", "null"], "minimum": 0, "maximum": 1}}
    return {"type": "object", "required": ["index", *named], "properties": properties | {k: {"type": "string", "enum": x} for k, x in named.items()}}


def reply_errors(replies: DataFrame, domain_labels: list[str], keep: int = 5) -> DataFrame:
    """stem, batch, error_count and the first `keep` errors of the replies that break the contract; coerce() mends them all the same."""
    told = violations(replies, schema_rules(contract(domain_labels)), keep).filter("n_violations > 0")
    first = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "reply_ord", "violations"))), lambda x: F.transform(x["violations"], lambda e: F.concat(x["index"].cast("string"), F.lit("/"), e)))), 1, keep)
    return told.groupBy("stem", "batch").agg(F.sum("n_violations").alias("error_count"), first.alias("errors"))


def coerce(replies: DataFrame, domain_labels: list[str]) -> DataFrame:
    """Replies with vocabulary fields coerced exactly (no trimming) and confidence clamped; the last reply of an index counts."""
    last = replies.groupBy("stem", "batch", "index").agg(F.max_by(F.struct(*_FREE), "reply_ord").alias("r")).select("stem", "batch", "index", "r.*")
    vocabularies = {"domain": domain_labels, "action": ACTIONS, "obligation_type": OBLIGATIONS, "mandatory_flag": MODALITIES}
    return last.withColumns({k: v.allowed_or(F.col(k), allowed, ESCAPE[k]) for k, allowed in vocabularies.items()} | {"confidence_score": v.confidence(F.col("confidence_score"))})


def tag_units(nodes: DataFrame, domain_labels: list[str], classifier: Callable[[list[dict]], list[dict]] | None = None, size: int = 20) -> DataFrame:
    """nodes with is_operative and the semantic fields: null where not operative, not answered, or without a classifier."""
    work = units(nodes, size)
    if classifier is None:
        types = ["string"] * 6 + ["double"]
        tags = work.select("stem", "ord", *(F.lit(None).cast(t).alias(c) for c, t in zip(_FREE, types, strict=True)))
    else:
        tags = work.join(coerce(ask(work, classifier), domain_labels), ["stem", "batch", "index"], "left").select("stem", "ord", *_FREE)
    return nodes.join(tags.withColumn("is_operative", F.lit(True)), ["stem", "ord"], "left").withColumn("is_operative", F.coalesce("is_operative", F.lit(False)))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """stem, operative, classified, unclassified."""
    return tagged.filter("is_operative").groupBy("stem").agg(F.count("*").alias("operative"), F.count("action").alias("classified"), F.count_if(F.col("action").isNull()).alias("unclassified"))
