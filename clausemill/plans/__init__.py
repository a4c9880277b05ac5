"""Whole runs: all steps of a corpus in order, over every document at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import adjacency as ad
from clausemill.operators import clauses as cl
from clausemill.operators import extract, graph, index, interpret, matching, search, structure


@dataclass
class Corpus:
    """Tables of a run, each read back from its folder."""

    lines: DataFrame
    nodes: DataFrame
    clauses: DataFrame
    objects: DataFrame
    graph_nodes: DataFrame
    graph_edges: DataFrame
    postings: DataFrame
    idf: DataFrame
    weights: DataFrame
    lexicon: DataFrame
    document_idf: DataFrame
    document_weights: DataFrame
    nodes_by_id: DataFrame
    edges_by_source: DataFrame
    edges_by_target: DataFrame

    def index(self) -> search.Index:
        """The index of all documents together."""
        return search.Index(self.lexicon, self.weights)

    def document_index(self) -> search.DocumentIndex:
        """The indexes of single documents."""
        return search.DocumentIndex(self.document_idf, self.document_weights)

    def adjacency(self) -> ad.Adjacency:
        """The graph, to be asked by key."""
        return ad.Adjacency(self.nodes_by_id, self.edges_by_source, self.edges_by_target)


def run(path: str, pages: DataFrame, catalog: DataFrame, domains: DataFrame, metadata: DataFrame, denoise: bool = True, classifier: Callable | None = None, level_hook: Callable | None = None, rules: matching.Rules = matching.Rules()) -> Corpus:
    """pages (stem, page_no, text) to every table, each step written below `path` and read back by the next; a step that fails stops the run.

    metadata: stem, document_id, regulator, regulator_country, title, source_type, version, jurisdiction, catalog_version.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    labels = [r["label"] for r in domains.select("label").collect()]  # a taxonomy of tens of rows
    lines = keep("lines", extract.markdown_lines(extract.denoise_pages(pages) if denoise else pages))
    tree = keep("tree", structure.build_structure(lines, level_hook))
    nodes = keep("nodes", interpret.tag_units(tree, labels, classifier))
    clauses = keep("clauses", cl.export_clauses(nodes, domains))
    objects = keep("objects", matching.ontology_objects(clauses, catalog, domains, rules))
    graph_nodes, graph_edges = graph.build_graph(clauses, objects, metadata, catalog, domains, keep)
    graph_nodes, graph_edges = keep("graph_nodes", graph_nodes), keep("graph_edges", graph_edges)
    near = ad.store(graph_nodes, graph_edges, keep)
    post = keep("postings", index.postings(clauses))
    idf = keep("idf", index.corpus_idf(post, clauses))
    weights = keep("weights", search.impact_ordered(index.unit_weights(post, idf)))
    own = keep("document_idf", index.document_idf(post, clauses).repartitionByRange("term", "stem").sortWithinPartitions("term", "stem"))
    own_weights = keep("document_weights", search.impact_ordered(index.unit_weights(post, own)))
    return Corpus(lines, nodes, clauses, objects, graph_nodes, graph_edges, post, idf, weights, keep("lexicon", search.lexicon(weights, idf)), own, own_weights, near.nodes, near.by_source, near.by_target)


#: Tables of a run by step, as folders below its path.
STEPS = ["lines", "tree", "nodes", "clauses", "objects", "graph_nodes", "graph_edges", "postings", "idf", "weights", "lexicon", "document_idf", "document_weights", "nodes_by_id", "edges_by_source", "edges_by_target"]


def load(spark: SparkSession, path: str) -> Corpus:
    """The tables of a finished run."""
    return Corpus(**{name: spark.read.parquet(f"{path}/{name}") for name in STEPS if name != "tree"})


def summaries(corpus: Corpus) -> DataFrame:
    """stem, step, what, n: counts that describe each step's result."""
    count = lambda df, step, what: df.groupBy("stem", what.alias("what")).agg(F.count("*").alias("n")).select("stem", F.lit(step).alias("step"), "what", "n")
    parts = [
        count(corpus.lines.filter("startswith(raw, '## ')"), "lines", F.lit("headings")),
        count(corpus.nodes, "structure", F.col("type")),
        count(corpus.nodes.filter("is_operative"), "semantics", F.coalesce("obligation_type", F.lit("unclassified"))),
        count(corpus.clauses, "clauses", F.lit("clauses")),
        count(corpus.objects, "objects", F.col("match_type")),
        count(corpus.graph_nodes, "graph nodes", F.col("type")),
        count(corpus.graph_edges, "graph edges", F.col("type")),
        corpus.postings.groupBy("stem").agg(F.count_distinct("term").alias("n")).select("stem", F.lit("index").alias("step"), F.lit("vocabulary").alias("what"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
