"""Hits enriched from the graph: evidence, related clauses elsewhere, reasoning path, confidence, citations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.adjacency import Adjacency
from clausemill.tables import settle

# Score limits of the bands (strong, moderate).
SPARSE_BANDS = (0.30, 0.15)
DENSE_BANDS = (0.50, 0.32)


def _prop(name: str) -> object:
    return F.col("properties").getItem(name)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows, as the hits of one question have."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _edges(edges: DataFrame | Adjacency, kind: str, keys: DataFrame, end: str) -> DataFrame:
    """Edges of a kind whose source or target is among the keys."""
    if isinstance(edges, Adjacency):
        return edges.edges_from(kind, keys) if end == "source" else edges.edges_to(kind, keys)
    return edges.filter(F.col("type") == kind).join(small(keys.toDF(end).distinct()), end, "left_semi")


def enrich(hits: DataFrame, nodes: DataFrame | Adjacency, edges: DataFrame | Adjacency) -> DataFrame:
    """hits (document_id, clause_id, ...) with canonical_id, canonical_label, mapping_confidence, review_required, concept_parent, obligation_type.

    nodes and edges are those of all documents, united or not, or both the same Adjacency, of which the keys' folders are read.  Of several edges of a kind the last counts, by edge_ord where the edges have it.  Edges and nodes are met by the few
    keys that the hits need, so that a graph kept as a table is read, and neither shuffled nor sorted.
    """
    columns = edges.by_source.columns if isinstance(edges, Adjacency) else edges.columns
    at = F.col("edge_ord") if "edge_ord" in columns else F.struct("target", "provenance")

    def last(kind: str, sources: DataFrame, *more: str) -> DataFrame:
        mine = _edges(edges, kind, sources, "source")
        return settle(mine.groupBy("source").agg(F.max_by(F.struct("target", *more), at).alias("e")), "found")  # as few rows as hits

    def label(ids: DataFrame, name: str, kind: str, **properties: str) -> DataFrame:
        mine = nodes.nodes_of(ids) if isinstance(nodes, Adjacency) else nodes.filter(F.col("type") == kind).join(small(ids.toDF("id").distinct()), "id", "left_semi")
        own = F.struct(*(_prop(p).alias(n) for n, p in properties.items()))
        first = F.min_by(own, "stem") if "stem" in mine.columns else F.first(own)  # as in the union of all graphs, the first document's node counts
        return mine.groupBy("id").agg(first.alias("p")).select(F.col("id").alias(f"__{name}_id"), "p.*")

    x = hits.withColumn("clause_node", F.concat(F.lit("Clause:"), F.col("document_id"), F.lit("/"), F.col("clause_id")))
    concept = last("MAPS_TO_CONCEPT", x.select("clause_node"), "provenance").select(F.col("source").alias("__c"), F.col("e.target").alias("concept_node"), F.col("e.provenance.match_confidence").alias("mapping_confidence"), F.col("e.provenance.review_required").alias("review_required"))
    bound = last("HAS_OBLIGATION", x.select("clause_node")).select(F.col("source").alias("__b"), F.col("e.target").alias("__obligation"))
    parent = last("CHILD_OF", concept.select("concept_node")).select(F.col("source").alias("__k"), F.col("e.target").alias("__parent"))
    x = x.join(concept, F.col("clause_node") == F.col("__c"), "left").join(label(concept.select("concept_node"), "concept", "Concept", canonical_id="canonical_id", canonical_label="label"), F.col("concept_node") == F.col("__concept_id"), "left")
    x = x.join(parent, F.col("concept_node") == F.col("__k"), "left").join(label(parent.select("__parent"), "parent", "Concept", concept_parent="label"), F.col("__parent") == F.col("__parent_id"), "left")
    x = x.join(bound, F.col("clause_node") == F.col("__b"), "left").join(label(bound.select("__obligation"), "duty", "ObligationType", obligation_type="label"), F.col("__obligation") == F.col("__duty_id"), "left")
    return x.select(*hits.columns, "concept_node", "canonical_id", "canonical_label", "mapping_confidence", "review_required", "concept_parent", "obligation_type")


def impact_candidates(evidence: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """Clauses of documents outside the hits that map to a concept the hits touch: concept, canonical_id, document_id, clause_no, page."""
    touched = evidence.filter("concept_node IS NOT NULL").groupBy("concept_node").agg(F.first("canonical_label", ignorenulls=True).alias("concept"), F.first("canonical_id", ignorenulls=True).alias("canonical_id"))
    mapped = _edges(edges, "MAPS_TO_CONCEPT", evidence.select("concept_node").filter("concept_node IS NOT NULL"), "target").select("target", "provenance.document_id", "provenance.clause_no", "provenance.page")
    inside = evidence.select(F.col("document_id").alias("__d")).distinct()
    return mapped.join(small(touched), F.col("target") == F.col("concept_node")).join(small(inside), F.col("document_id") == F.col("__d"), "left_anti").select("concept", "canonical_id", "document_id", "clause_no", "page")


def attach_text(evidence: DataFrame, clauses: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds text: the clause's own, else its title.  documents: document_id, stem (the last stem of a document counts)."""
    stems = documents.join(small(evidence.select("document_id").distinct()), "document_id", "left_semi").groupBy("document_id").agg(F.max("stem").alias("__stem"))
    own = clauses.select(F.col("stem").alias("__s"), F.col("clause_id").alias("__c"), F.col("text").alias("__text"))
    own = own.join(small(stems.select(F.col("__stem").alias("__s")).distinct()), "__s", "left_semi")
    x = evidence.join(stems, "document_id", "left").join(own, (F.col("__stem") == F.col("__s")) & (F.col("clause_id") == F.col("__c")), "left")
    return x.withColumn("text", tx.present("__text", "title")).drop("__stem", "__s", "__c", "__text")


def confidence(evidence: DataFrame, dense: bool = False) -> DataFrame:
    """One row: retrieval_band, top_score, mean_score (of rounded scores), retrieval_mode, evidence_pending_review."""
    strong, moderate = DENSE_BANDS if dense else SPARSE_BANDS
    x = evidence.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), F.coalesce(F.round(F.avg("score"), 4), F.lit(0.0)).alias("mean_score"), F.count_if("review_required").alias("evidence_pending_review"))
    band = F.when(F.col("top_score") >= strong, "High").when(F.col("top_score") >= moderate, "Medium").otherwise("Low")
    return x.select(band.alias("retrieval_band"), "top_score", "mean_score", F.lit("embedding" if dense else "tfidf").alias("retrieval_mode"), "evidence_pending_review")


def reasoning_path(evidence: DataFrame, impact: DataFrame) -> DataFrame:
    """One row: path, an array of sentences about the evidence."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))), ", ")
    e = evidence.agg(F.count("*").alias("hits"), F.count_distinct("concept_node").alias("concepts"), names("canonical_label").alias("labels"), names("concept_parent").alias("parents"), F.count_if("review_required").alias("pending"))
    x = e.withColumn("related", impact.agg(F.count("*").alias("related")).scalar())
    say = lambda condition, *words: F.when(condition, F.concat(*(F.lit(w) if isinstance(w, str) else w.cast("string") for w in words)))
    c = F.col
    steps = [
        say(F.lit(True), "Retrieved ", c("hits"), " clause(s) by semantic similarity across the indexed corpus."),
        say(c("concepts") > 0, "Evidence maps to ", c("concepts"), " canonical concept(s): ", c("labels"), "."),
        say(c("parents") != "", "Those concepts sit under parent concept(s): ", c("parents"), "."),
        say(c("related") > 0, "Found ", c("related"), " related clause(s) in other documents sharing these concepts (cross-reference candidates)."),
        say(c("pending") > 0, c("pending"), " of ", c("hits"), " evidence clause(s) rely on a concept mapping still pending compliance review."),
    ]
    return x.select(F.array_compact(F.array(*steps)).alias("path"))


def ungrounded(answers: DataFrame, evidence: DataFrame, answer: str = "answer", by: list[str] | None = None) -> DataFrame:
    """Citations in answers whose clause number no evidence has (the document is not compared): [by...], citation, ord."""
    by = by or []
    cited = answers.select(*by, F.posexplode(tx.citations(F.col(answer))).alias("ord", "__c")).select(*by, "ord", F.col("__c.document").alias("__d"), F.col("__c.clause_no").alias("__n"))
    known = evidence.select(*(F.col(x).alias(f"__by_{x}") for x in by), F.col("clause_no").cast("string").alias("__known")).distinct()
    same = F.col("__n") == F.col("__known")
    for x in by:
        same = same & (F.col(x) == F.col(f"__by_{x}"))
    return cited.join(known, same, "left_anti").select(*by, F.concat(F.lit("["), F.col("__d"), F.lit(" "), F.col("__n"), F.lit("]")).alias("citation"), "ord")


def evidence_view(evidence: DataFrame, width: int = 110) -> DataFrame:
    """Evidence in reading order with short titles, for people."""
    tag = tx.present("obligation_type", "canonical_label")
    return evidence.orderBy(F.desc("score"), "document_id", "clause_id").select("score", "document_id", "clause_no", tag.alias("tag"), F.substring(F.coalesce("title", F.lit("")), 1, width).alias("title"))


@dataclass
class Answer:
    """Parts of an answer, each a lazy DataFrame; answer is text, or None without a synthesizer."""

    evidence: DataFrame
    impact: DataFrame
    path: DataFrame
    confidence: DataFrame
    answer: str | None
    ungrounded: DataFrame | None


def answer(query: str, hits: DataFrame, clauses: DataFrame, nodes: DataFrame | Adjacency, edges: DataFrame | Adjacency, documents: DataFrame, dense: bool = False, synthesizer: Callable[[str, list[dict]], str] | None = None) -> Answer:
    """Everything about a question.  hits: document_id, clause_id, clause_no, title, page, score (top k, so a few rows).

    The evidence is written once, as everything else is made of it.
    """
    evidence = settle(attach_text(enrich(settle(hits, "hits"), nodes, edges), clauses, documents), "evidence")
    impact = impact_candidates(evidence, edges)
    text, loose = None, None
    if synthesizer is not None:
        rows = [r.asDict() for r in evidence.orderBy(F.desc("score")).limit(100).collect()]
        if rows:
            text = synthesizer(query, rows)
            loose = ungrounded(evidence.sparkSession.createDataFrame([(text,)], "answer string"), evidence)
    return Answer(evidence, impact, reasoning_path(evidence, impact), confidence(evidence, dense), text, loose)
