"""Tree rows to flat clauses, and batches of units for model hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx


def number_clauses(nodes: DataFrame, order: list[str], stem: str = "stem", number: str = "number") -> DataFrame:
    """Adds clause_id: clause_<number>, with __n from the second of a document on."""
    base = F.concat(F.lit("clause_"), F.replace(number, F.lit("."), F.lit("_")))
    turn = F.row_number().over(Window.partitionBy(stem, number).orderBy(*order))
    return nodes.withColumn("__turn", turn).withColumn("clause_id", F.concat(base, F.when(F.col("__turn") > 1, F.concat(F.lit("__"), F.col("__turn"))).otherwise(""))).drop("__turn")


def domain_tokens(df: DataFrame, domains: DataFrame, column: str, out: str = "domain_token", escape: str = "OTHER") -> DataFrame:
    """Adds the token of a domain label; unknown labels get the escape token, null stays null."""
    last = domains.select(F.col("label").alias("__label"), F.col("token").alias("__token"))
    x = df.join(last, F.col(column) == F.col("__label"), "left")
    return x.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("__token", F.lit(escape)))).drop("__label", "__token")


def exportable() -> Column:
    return F.col("type").isin("section", "subsection", "clause") & tx.is_clause_number(F.col("number"))


def export_clauses(nodes: DataFrame, domains: DataFrame, escape: str = "OTHER") -> DataFrame:
    """Numbered sections and subsections as clauses.  nodes may carry the semantic fields; missing ones are null."""
    fields = {"domain": "string", "concept": "string", "action": "string", "object": "string", "obligation_type": "string", "mandatory_flag": "string", "confidence_score": "double"}
    x = nodes.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in nodes.columns})
    x = domain_tokens(number_clauses(x.filter(exportable()), ["ord"]), domains, "domain", escape=escape)
    semantic = F.struct(F.col("domain_token").alias("domain"), *(c for c in fields if c != "domain"))
    return x.select("stem", "ord", "clause_id", F.col("number").alias("clause_no"), F.col("heading").alias("title"), "text", F.col("page_start").alias("page_reference"), semantic.alias("semantic"))


def clause_counts(clauses: DataFrame) -> DataFrame:
    """Per document: clauses, those without text, and those with text but no action."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return clauses.groupBy("stem").agg(F.count("*").alias("clause_count"), F.count_if(blank).alias("header_only"), F.count_if(F.col("semantic.action").isNull() & ~blank).alias("missed"))


def batch_ids(df: DataFrame, order: list[str], size: int, group: str = "stem") -> DataFrame:
    """Adds batch and index: groups of `size` rows in order, per group; both from 0."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("__turn", turn).withColumns({"batch": F.floor(F.col("__turn") / size).cast("int"), "index": (F.col("__turn") % size).cast("int")}).drop("__turn")
