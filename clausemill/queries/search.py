"""Queries over sparse and dense indexes.  A source stands for a file, a document for a clause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import values as v
from clausemill.operators import cells as ce
from clausemill.operators import index as ix
from clausemill.operators import search as se
from clausemill.queries.base import sql_tokens, table
from clausemill.tables import kept, settle

QUESTION = "Does inging an erble keit eau the ción, and for thention rea?"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("stem"), F.col("doc_id").alias("ord"), "text")


def _post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(_rows(spark, sf_dir), F.col("text"))


def _index(spark: SparkSession, sf_dir: str) -> se.Index:
    """The corpus index, built by the first question of a session."""
    made = kept(spark, "index", [f"{sf_dir}/documents.parquet"], lambda: (lambda x: (x.lexicon, x.weights))(se.build_from_text(_rows(spark, sf_dir), F.col("text"))))
    return se.Index(*made)


def _by_document(spark: SparkSession, sf_dir: str) -> se.DocumentIndex:
    made = kept(spark, "index_by_document", [f"{sf_dir}/documents.parquet"], lambda: (lambda x: (x.idf, x.weights))(se.build_by_document_from_text(_rows(spark, sf_dir), F.col("text"))))
    return se.DocumentIndex(*made)


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _post(spark, sf_dir).groupBy("stem", "term").agg(F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.document_idf(_post(spark, sf_dir), _rows(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def idf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.corpus_idf(_post(spark, sf_dir), _rows(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def idf_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of all documents loaded, those with repeated lines revised, and toxic ones taken down: added up, not counted anew."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    revised = docs.withColumn("once", once).filter("once <> text")
    counted = lambda df, text, sign: ix.frequency_changes(ix.clause_terms(df, F.col(text)), df, sign)
    few = toxic.count() <= 1_000_000  # else a join by shuffle, which Spark's own filters thin out first
    current = docs.join(F.broadcast(toxic) if few else toxic, "doc_id", "left_semi").withColumn("once", F.coalesce(once, "text"))
    batches = [counted(docs, "text", 1), ix.revision_changes(revised, F.col("text"), F.col("once")), counted(current, "once", -1)]
    changes = [settle(x, "changes", even=False) for x in batches]  # each as a batch commits it, a row for each term
    united = changes[0]
    for x in changes[1:]:
        united = united.unionByName(x)
    return ix.idf_of_changes(united).withColumn("idf", F.round("idf", 6))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    weights = se.text_weights(rows, F.col("text"), se.text_idf(rows, F.col("text")))
    return weights.groupBy("stem", "ord").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.sum("weight"), 6).alias("total"))


def search_topk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.top_hits(se.top_scores(_index(spark, sf_dir), QUESTION, 6), None).drop("kind")


def search_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_documents(_by_document(spark, sf_dir), QUESTION)


def search_weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document and corpus search without an index: texts are weighed at the question."""
    rows, text = _rows(spark, sf_dir), F.col("text")
    corpus = ix.top_hits(se.text_scores(rows, text, se.text_idf(rows, text), QUESTION), None).select("stem", "ord", "score", F.lit(0).alias("rank"))
    own = settle(se.text_document_idf(rows, text), "idf_by_document", even=False)
    return ix.best_of_each(se.text_scores(rows, text, own, QUESTION)).select("stem", "ord", "score", "rank").union(corpus)


QUESTIONS = [QUESTION, "the and la des der para", "keine ción nowhere"]


def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions to one index: each reads the weights of its own terms, above what can be among the best."""
    index = _index(spark, sf_dir)
    hits = [ix.top_hits(se.top_scores(index, q, 6), None).select(F.lit(k).alias("question"), "stem", "ord", "score") for k, q in enumerate(QUESTIONS)]
    return hits[0].union(hits[1]).union(hits[2])


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index knows of each term: document frequency, idf and the bounds of its weights."""
    top = F.round("top", 6).alias("top")
    return _index(spark, sf_dir).lexicon.select("term", "df", F.round("idf", 6).alias("idf"), top, F.aggregate("levels", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_weights"))


def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_meta(_post(spark, sf_dir), _rows(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("stem"), F.col("vec_id").alias("ord"), v.unit_array(F.col("embedding")).alias("vector"))


def _cells(spark: SparkSession, sf_dir: str) -> ce.Cells:
    return ce.Cells(*kept(spark, "cells", [f"{sf_dir}/embeddings.parquet"], lambda: (lambda x: (x.centres, x.vectors))(ce.build(_vectors(spark, sf_dir)))))


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    query = _vectors(spark, sf_dir).filter("ord = 0").first()["vector"]
    return ce.top_scores(_cells(spark, sf_dir), query, k)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.top_hits(None, _dense(spark, sf_dir, 6)).drop("kind")


def dense_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all vectors, without cells; the question is a row."""
    vectors = _vectors(spark, sf_dir)
    return ix.top_hits(None, ix.dense_scores(vectors, vectors.filter("ord = 0").select(F.col("vector").alias("query")))).drop("kind")


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors the cells hold, each once, and whether every one lies within its cell's radius."""
    cells = _cells(spark, sf_dir)
    x = cells.vectors.join(cells.centres, "cell")
    inside = F.acos(F.least(F.lit(1.0), v.dot(F.col("vector"), F.col("centre")))) <= F.col("radius") + 1e-9
    return x.agg(F.count("*").alias("n_vectors"), F.count_distinct("ord").alias("n_ids"), F.bool_and(inside).alias("inside"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.top_hits(se.top_scores(_index(spark, sf_dir), QUESTION, 12), _dense(spark, sf_dir, 12), 12)


QUERIES = {f.__name__: f for f in (term_frequency, doc_frequency, idf_corpus, idf_incremental, tfidf_vectors, search_topk_corpus, search_topk_per_source, search_weighed, search_stored_index, search_terms, index_meta, dense_topk, dense_scan, dense_cells, hybrid_topk)}

_POST = f"p AS (SELECT source AS stem, doc_id AS ord, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL)"
_IDF = "i AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM p GROUP BY term)"
_QUERY = f"q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({sql_tokens(chr(39) + QUESTION + chr(39))}) AS term) GROUP BY term)"
_SCORES = "w AS (SELECT term, qtf * idf / sqrt(sum((qtf * idf) ** 2) OVER ()) AS qw FROM q JOIN i USING (term)), s AS (SELECT stem, ord, sum(tf * idf * qw) / sqrt(sum((tf * idf) ** 2)) AS score FROM p JOIN i USING (term) LEFT JOIN w USING (term) GROUP BY ALL)"
_ASKED = "a AS (" + " UNION ALL ".join(f"SELECT {k} AS question, unnest({sql_tokens(chr(39) + q + chr(39))}) AS term" for k, q in enumerate(QUESTIONS)) + ")"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
_DENSE = f"u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), z AS (SELECT 'embeddings' AS stem, a.vec_id AS ord, list_dot_product(a.v, b.v) AS score FROM u a, u b WHERE b.vec_id = 0)"

ORACLES = {
    "term_frequency": f"WITH {_POST} SELECT stem, term, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM p GROUP BY stem, term",
    "doc_frequency": f"WITH {_POST}, n AS (SELECT source AS stem, count(*) AS n FROM documents GROUP BY source), f AS (SELECT stem, term, count(*) AS df FROM p GROUP BY stem, term) SELECT stem, term, df, round(ln((n + 1.0) / (df + 1.0)) + 1.0, 6) AS idf FROM f JOIN n USING (stem)",
    "idf_corpus": f"WITH {_POST}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM i",
    "tfidf_vectors": f"WITH {_POST}, {_IDF}, x AS (SELECT stem, ord, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY stem, ord)) AS norm FROM p JOIN i USING (term)) SELECT stem, ord, count(*) AS terms, round(max(w / norm), 6) AS largest, round(sum(w / norm), 6) AS total FROM x GROUP BY stem, ord",
    "search_topk_corpus": f"WITH {_POST}, {_IDF}, {_QUERY}, {_SCORES} SELECT stem, ord, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY 3 DESC, stem, ord LIMIT 6",
    "search_topk_per_source": f"WITH {_POST}, n AS (SELECT source AS stem, count(*) AS n FROM documents GROUP BY source), i AS (SELECT stem, term, ln((max(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM p JOIN n USING (stem) GROUP BY stem, term), {_QUERY}, w AS (SELECT stem, term, qtf * idf / sqrt(sum((qtf * idf) ** 2) OVER (PARTITION BY stem)) AS qw FROM q JOIN i USING (term)), s AS (SELECT stem, ord, sum(tf * idf * qw) / sqrt(sum((tf * idf) ** 2)) AS score FROM p JOIN i USING (stem, term) LEFT JOIN w USING (stem, term) GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY stem ORDER BY round(score, 10) DESC, ord))::INTEGER AS rank FROM s WHERE score > 0) SELECT stem, ord, round(score, 4) AS score, rank FROM r WHERE rank <= 5",
    "search_terms": f"WITH {_POST}, {_IDF}, n AS (SELECT stem, ord, sqrt(sum((tf * idf) ** 2)) AS norm FROM p JOIN i USING (term) GROUP BY ALL) SELECT term, any_value(df) AS df, round(any_value(idf), 6) AS idf, round(max(tf * idf / norm), 6) AS top, count(*) AS n_weights FROM p JOIN i USING (term) JOIN n USING (stem, ord) GROUP BY term",
    "search_stored_index": f"WITH {_POST}, {_IDF}, {_ASKED}, q AS (SELECT question, term, count(*) AS qtf FROM a GROUP BY ALL), w AS (SELECT question, term, qtf * idf / sqrt(sum((qtf * idf) ** 2) OVER (PARTITION BY question)) AS qw FROM q JOIN i USING (term)), n AS (SELECT stem, ord, sqrt(sum((tf * idf) ** 2)) AS norm FROM p JOIN i USING (term) GROUP BY ALL), s AS (SELECT question, stem, ord, sum(tf * idf / norm * qw) AS score FROM p JOIN i USING (term) JOIN w USING (term) JOIN n USING (stem, ord) GROUP BY ALL) SELECT question, stem, ord, round(score, 4) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question ORDER BY round(score, 4) DESC, stem, ord) <= 6",
    "index_meta": f"WITH {_POST}, n AS (SELECT source AS stem, count(*) AS clause_count FROM documents GROUP BY source) SELECT n.stem, clause_count, count(DISTINCT term) AS vocabulary_size FROM n LEFT JOIN p ON n.stem = p.stem GROUP BY ALL",
    "dense_topk": f"WITH {_DENSE} SELECT stem, ord, round(score, 4) AS score FROM z WHERE score > 0 ORDER BY 3 DESC, stem, ord LIMIT 6",
    "hybrid_topk": f"WITH {_POST}, {_IDF}, {_QUERY}, {_SCORES}, {_DENSE} SELECT stem, ord, round(score, 4) AS score, kind FROM (SELECT *, 0 AS kind FROM s UNION ALL SELECT *, 1 AS kind FROM z) WHERE score > 0 ORDER BY 3 DESC, kind, stem, ord LIMIT 12",
}
ORACLES["search_weighed"] = f"SELECT stem, ord, score, rank FROM ({ORACLES['search_topk_per_source']}) UNION ALL SELECT stem, ord, score, 0::INTEGER AS rank FROM ({ORACLES['search_topk_corpus']})"
ORACLES["dense_scan"] = ORACLES["dense_topk"]
ORACLES["dense_cells"] = "SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, true AS inside FROM embeddings"
_ONCE = "array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), generate_series(1, len(string_split(text, chr(10))))), lambda x: list_position(string_split(text, chr(10)), x[1]) = x[2]), lambda x: x[1]), chr(10))"
ORACLES["idf_incremental"] = f"WITH live AS (SELECT source, doc_id, {_ONCE} AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_POST.replace('FROM documents', 'FROM live')}, i AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT term, df, round(ln(((SELECT count(*) FROM live) + 1.0) / (df + 1.0)) + 1.0, 6) AS idf FROM i"
