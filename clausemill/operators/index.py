"""Sparse and dense indexes, and search over them.

Postings are long rows (stem, ord, term, tf).  search() and retrieve() weigh them at query time, under the idf of what is
searched.  A corpus that is asked often keeps stored_weights(): unit weights by term, so that a question reads the row
groups of its own terms and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.functions import text as tx
from clausemill.functions import values as v
from clausemill.hooks import choose_embedder


def enriched_text() -> Column:
    """Title, text, concept and object of a clause, those that are there, joined by a space."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "text", "semantic.concept", "semantic.object")))


def postings(rows: DataFrame, text: Column | None = None, stem: str = "stem", order: str = "ord") -> DataFrame:
    """stem, ord, term, tf.  The word filter runs after the explode, inside code generation."""
    words = rows.select(F.col(stem).alias("stem"), F.col(order).alias("ord"), F.explode(F.regexp_extract_all(F.lower(enriched_text() if text is None else text), F.lit("[a-z0-9]+"), 0)).alias("term"))
    return words.filter((F.length("term") > 1) & ~F.col("term").isin(tx.STOPWORDS)).groupBy("stem", "ord", "term").agg(F.count("*").alias("tf"))


def _rows_with_tf() -> Column:
    """Rows, counted over tf: the plan below is then that of the postings, and Spark reuses their shuffle."""
    return F.count_if(F.col("tf") > 0)


def document_idf(post: DataFrame, rows: DataFrame, stem: str = "stem") -> DataFrame:
    """stem, term, df, idf within each document; rows counts its clauses, also those without words."""
    n = rows.groupBy(F.col(stem).alias("stem")).agg(F.count("*").alias("n"))
    return post.groupBy("stem", "term").agg(_rows_with_tf().alias("df")).join(n, "stem").select("stem", "term", "df", v.idf(F.col("n"), F.col("df")).alias("idf"))


def corpus_idf(post: DataFrame, rows: DataFrame) -> DataFrame:
    """term, df, idf over all documents together."""
    n = rows.agg(F.count("*").alias("n")).scalar()
    return post.groupBy("term").agg(_rows_with_tf().alias("df")).select("term", "df", v.idf(n, F.col("df")).alias("idf"))


def _different(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def is_term() -> Column:
    return (F.length("term") > 1) & ~F.col("term").isin(tx.STOPWORDS)


def clause_terms(rows: DataFrame, text: Column | None = None, *by: str) -> DataFrame:
    """Columns `by`, term: each clause's different terms, a row for each, without a shuffle; for what needs no counts within clauses."""
    return rows.select(*by, F.explode(_different(enriched_text() if text is None else text)).alias("term")).filter(is_term())


def frequency_changes(post: DataFrame, rows: DataFrame, sign: int = 1) -> DataFrame:
    """term, d_df, d_rows: what clauses add to document frequencies (sign 1), or take away (-1); a row without a term counts the clauses.

    post: postings, or clause_terms(), of the clauses `rows`.

    Changes of any batches are united and added up by add_changes(), in any order: of an old text taken away and a new one added,
    what stays the same cancels.
    """
    counted = post.groupBy("term").agg((F.count("*") * sign).alias("d_df")).select("term", "d_df", F.lit(0).cast("long").alias("d_rows"))
    return counted.unionByName(rows.agg((F.count("*") * sign).alias("d_rows")).select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("d_df"), "d_rows"))


def revision_changes(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """frequency_changes() of clauses whose text becomes another: a term in both texts of a clause cancels within its row and is not shuffled."""
    both = rows.select(F.coalesce(_different(old), F.array()).alias("old"), F.coalesce(_different(new), F.array()).alias("new"))
    gone = both.select(F.explode(F.array_except("old", "new")).alias("term"), F.lit(-1).cast("long").alias("d_df"))
    come = both.select(F.explode(F.array_except("new", "old")).alias("term"), F.lit(1).cast("long").alias("d_df"))
    return gone.unionByName(come).filter(is_term()).groupBy("term").agg(F.sum("d_df").alias("d_df")).filter("d_df <> 0").select("term", "d_df", F.lit(0).cast("long").alias("d_rows"))


def add_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("term").agg(F.sum("d_df").alias("d_df"), F.sum("d_rows").alias("d_rows")).filter("d_df <> 0 OR d_rows <> 0")


def idf_of_changes(changes: DataFrame) -> DataFrame:
    """corpus_idf() of all that was added and not taken away."""
    total = add_changes(changes)
    n = F.coalesce(total.filter("term IS NULL").select(F.first("d_rows").alias("n")).scalar(), F.lit(0))
    return total.filter("term IS NOT NULL AND d_df > 0").select("term", F.col("d_df").alias("df"), v.idf(n, F.col("d_df")).alias("idf"))


def unit_weights(post: DataFrame, idf: DataFrame) -> DataFrame:
    """stem, ord, term, weight: tf x idf at unit length.  idf may be by stem and term, or by term."""
    keys = ["stem", "term"] if "stem" in idf.columns else ["term"]
    x = post.join(idf.select(*keys, "idf"), keys).withColumn("w", F.col("tf") * F.col("idf"))
    norm = x.groupBy("stem", "ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, ["stem", "ord"]).select("stem", "ord", "term", v.unit(F.col("w"), F.col("norm")).alias("weight"))


def query_weights(idf: DataFrame, query: str) -> DataFrame:
    """The query's terms that the index knows, at unit length: as many rows as it has different words."""
    terms = idf.sparkSession.range(1).select(F.explode(tx.tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    by = ["stem"] if "stem" in idf.columns else []
    x = idf.join(F.broadcast(terms), "term").withColumn("w", F.col("qtf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by)))  # over the words of one query
    return x.select(*by, "term", v.unit(F.col("w"), norm).alias("qw"))


def sparse_scores(post: DataFrame, idf: DataFrame, query: str) -> DataFrame:
    """stem, ord, score > 0: cosine of each clause that shares a term with the query.

    Norms need all terms of a clause, so one pass sums squares and the query's products together.
    """
    by = ["stem"] if "stem" in idf.columns else []
    wanted = query_weights(idf, query)
    known = idf.select(*by, "term", "idf").join(F.broadcast(wanted) if not by else wanted, [*by, "term"], "left")
    x = post.join(known, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    total = x.groupBy("stem", "ord").agg(F.sum(F.col("w") * F.col("w")).alias("squares"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return total.filter("dot > 0").select("stem", "ord", (F.col("dot") / F.sqrt("squares")).alias("score"))


def stored_weights(post: DataFrame, idf: DataFrame) -> DataFrame:
    """unit_weights() in order of term, to be written as a table: each file then holds a range of terms."""
    return unit_weights(post, idf).repartitionByRange("term", "stem", "ord").sortWithinPartitions("term")


def stored_scores(weights: DataFrame, idf: DataFrame, query: str) -> DataFrame:
    """sparse_scores() from tables of unit weights and idf by term.  The query's words are literals, which the scans push down."""
    words = [r["t"] for r in idf.sparkSession.range(1).select(F.explode(F.array_distinct(tx.tokens(F.lit(query)))).alias("t")).collect()]  # as many as the query has
    wanted = query_weights(idf.filter(F.col("term").isin(words)), query)
    found = weights.filter(F.col("term").isin(words)).join(F.broadcast(wanted), "term")
    return found.groupBy("stem", "ord").agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).filter("score > 0")


def search(post: DataFrame, rows: DataFrame, query: str, k: int = 5, stem: str = "stem") -> DataFrame:
    """Best k clauses of each document under its own weights: by exact score, then order; scores to four places."""
    return best_of_each(sparse_scores(post, document_idf(post, rows, stem), query), k)


def best_of_each(scored: DataFrame, k: int = 5) -> DataFrame:
    """stem, ord, score, rank: the best k of each document by exact score, then order; scores to four places."""
    turn = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc(F.round("score", 10)), "ord"))
    return scored.withColumn("rank", turn).filter(F.col("rank") <= k).withColumn("score", F.round("score", 4))


def dense_scores(vectors: DataFrame, query: Column | DataFrame, vector: str = "vector", stem: str = "stem", order: str = "ord") -> DataFrame:
    """stem, ord, score > 0: dot product with one query vector (a column, or a frame of one row with column `query`)."""
    rows = vectors.select(F.col(stem).alias("stem"), F.col(order).alias("ord"), F.col(vector).alias("vector"))
    if isinstance(query, DataFrame):
        rows = rows.withColumn("query", query.select(F.first("query").alias("query")).scalar())
        query = F.col("query")
    return rows.select("stem", "ord", v.dot(F.col("vector"), query).alias("score")).filter("score > 0")


def top_hits(sparse: DataFrame | None, dense: DataFrame | None, k: int = 6) -> DataFrame:
    """Best k of both: scores are rounded to four places first; ties keep sparse first, then document and order."""
    parts = [x.select("stem", "ord", F.round("score", 4).alias("score"), F.lit(kind).alias("kind")) for kind, x in ((0, sparse), (1, dense)) if x is not None]
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).orderBy(F.desc("score"), "kind", "stem", "ord").limit(k)


def retrieve(post: DataFrame, rows: DataFrame, query: str, k: int = 6, stem: str | None = None, dense: DataFrame | None = None) -> DataFrame:
    """Corpus-wide search under one shared idf; stem keeps one document (and prunes its partition)."""
    if stem is not None:
        post, rows = post.filter(F.col("stem") == stem), rows.filter(F.col("stem") == stem)
    return top_hits(sparse_scores(post, corpus_idf(post, rows), query), dense, k)


def index_meta(post: DataFrame, rows: DataFrame, stem: str = "stem") -> DataFrame:
    """stem, clause_count, vocabulary_size."""
    n = rows.groupBy(F.col(stem).alias("stem")).agg(F.count("*").alias("clause_count"))
    terms = post.groupBy("stem", "term").agg(F.lit(1).alias("one")).groupBy("stem").agg(F.count("*").alias("vocabulary_size"))
    return n.join(terms, "stem", "left").select("stem", "clause_count", F.coalesce("vocabulary_size", F.lit(0)).alias("vocabulary_size"))


def term_map(post: DataFrame, value: str = "tf") -> DataFrame:
    """stem, ord, terms: map of term to value, for export."""
    return post.groupBy("stem", "ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", value)))).alias("terms"))


def in_order(replies: list, n: int) -> list[list[float]]:
    """Vectors of n texts from a provider's replies: vectors in the order of the texts, or {index, embedding} in any order."""
    if replies and isinstance(replies[0], dict):
        replies = [x["embedding"] for x in sorted(replies, key=lambda x: x["index"]) if x.get("embedding") is not None]
    if len(replies) != n:
        raise ValueError(f"{n} texts, {len(replies)} vectors")
    return replies


def embed(rows: DataFrame, embedder: Callable[[list[str], bool], list], text: str = "text", batch: int = 64, limit: int = 8000) -> DataFrame:
    """Adds vector: unit-length embeddings from a hook, `batch` texts of at most `limit` characters a call (the model's own input limit)."""
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(frames):
        import numpy as np

        for pdf in frames:
            texts, out = pdf[text].fillna("").str[:limit].tolist(), []
            for at in range(0, len(texts), batch):
                part = [x or " " for x in texts[at : at + batch]]
                for x in in_order(embedder(part, False), len(part)):
                    norm = float(np.linalg.norm(x))
                    out.append([float(y) / norm for y in x] if norm else [float(y) for y in x])
            pdf["vector"] = out
            yield pdf[[*columns, "vector"]]

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Backend:
    """How clauses become an index (build) and a question its scores (scores), under a name that goes with the index."""

    name: str
    dense: bool
    build: Callable[[DataFrame], DataFrame]
    scores: Callable[[DataFrame, DataFrame, str], DataFrame]


def _sparse(name: str) -> Backend:
    return Backend(name, False, postings, lambda post, rows, query: sparse_scores(post, corpus_idf(post, rows), query))


def _dense(name: str, embedder: Callable[[list[str], bool], list]) -> Backend:
    def build(rows: DataFrame) -> DataFrame:
        return embed(rows.withColumn("__text", enriched_text()), embedder, "__text").select("stem", "ord", "vector")

    def scores(vectors: DataFrame, rows: DataFrame, query: str) -> DataFrame:
        x = in_order(embedder([query], True), 1)[0]
        norm = sum(float(y) ** 2 for y in x) ** 0.5 or 1.0
        return dense_scores(vectors, F.array(*(F.lit(float(y) / norm) for y in x)))

    return Backend(name, True, build, scores)


#: Names of backends; `embedding` takes the provider that choose_embedder() finds, the others force one.
BACKENDS = ("tfidf", "embedding", "azure", "nvidia")


def backend(name: str, embedders: dict[str, Callable[[list[str], bool], list]] | None = None) -> Backend:
    """The backend of this name.  embedders: the configured providers by name; dense backends carry the name of theirs."""
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(BACKENDS)}")
    if name == "tfidf":
        return _sparse(name)
    return _dense(*choose_embedder(embedders or {}, None if name == "embedding" else name))
