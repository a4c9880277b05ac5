"""The graph as projections of its rows: united as by documents, read kind by kind, spread where a key has many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import adjacency as ad
from clausemill.operators import graph as gr


def _graph(spark):
    semantic = "struct<domain:string,concept:string,action:string,obligation_type:string,mandatory_flag:string>"
    clauses = spark.createDataFrame(
        [
            ("d2", 0, "clause_1", "1", None, "b", 1, ("T0", "x", None, "Duty", "Y")),
            ("d2", 1, "clause_2", "2", None, "c", 1, ("T1", "x", None, None, "N")),
            ("d1", 0, "clause_1", "1", None, "a", 1, ("T0", "x", None, "Duty", "Y")),
            ("d1", 1, "clause_2", "2", None, "e", 2, ("T9", "y", None, "Other", "Y")),
            ("d3", 0, "clause_1", "1", None, "f", 3, (None, "x", None, None, None)),
            ("d4", 0, "x/clause_1", "1", None, "g", 3, (None, None, None, None, None)),
            ("d5", 0, "clause_1", "1", None, "h", 3, (None, None, None, None, None)),
        ],
        f"stem string, ord long, clause_id string, clause_no string, title string, text string, page_reference int, semantic {semantic}",
    )
    objects = spark.createDataFrame(
        [("d2", 0, "clause_1", "P", "late", "fuzzy", 0.5, True), ("d2", 1, "clause_2", "C", "named by d2", "fuzzy", 0.5, True), ("d1", 0, "clause_1", "C", None, "fuzzy", 0.7, False), ("d1", 1, "clause_2", "C", "own label", "fuzzy", 0.7, False), ("d3", 0, "clause_1", "Q", None, "fuzzy", 0.1, False)],
        "stem string, ord long, clause_id string, canonical_id string, canonical_label string, match_type string, match_confidence double, review_required boolean",
    )
    # d3 and d2 are one document by id; "A" + "x/clause_1" and "A/x" + "clause_1" give one clause id
    meta = spark.createDataFrame([("d1", "D1", "R", "X"), ("d2", "D2", "R", "Y"), ("d3", "D2", None, None), ("d4", "A", "S", None), ("d5", "A/x", "", None)], "stem string, document_id string, regulator string, regulator_country string")
    none = F.lit(None).cast("string")
    meta = meta.select("*", F.col("stem").alias("title"), none.alias("source_type"), none.alias("version"), none.alias("jurisdiction"), F.lit("v1").alias("catalog_version"))
    catalog = spark.createDataFrame([("C", "Child", "Early", "P", "approved"), ("P", "Parent", "Late", None, "approved")], "canonical_id string, label string, domain string, parent string, status string")
    domains = spark.createDataFrame([("T0", "Early"), ("T1", "Elsewhere")], "token string, label string")
    return gr.graph(clauses, objects, meta, catalog, domains)


def _rows(df):
    return sorted((r.asDict() for r in df.select("stem", "id", "type", "properties").collect()), key=lambda r: (r["id"], r["stem"]))


def test_united_nodes_are_those_of_the_documents_united(spark):
    g = _graph(spark)
    want = _rows(gr.union_graphs(g.nodes(), g.edges())[0])
    assert _rows(g.united(g.shared_nodes())) == want
    assert len({r["id"] for r in want}) == len(want)
    assert [r["properties"]["title"] for r in want if r["id"] == "Document:D2"] == ["d2"]
    assert [r["properties"]["text"] for r in want if r["id"] == "Clause:A/x/clause_1"] == ["g"]


def test_one_kind_of_edge_is_read_without_the_others_and_without_a_shuffle(spark):
    g = _graph(spark)
    g = gr.Graph(*(spark.createDataFrame(x.collect(), x.schema).localCheckpoint() for x in (g.rows, g.meta, g.catalog)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    mapped = g.edges().filter("type = 'MAPS_TO_CONCEPT'")
    assert "Exchange" not in plan(mapped) and "Union" not in plan(mapped) and "Generate" not in plan(mapped)
    assert mapped.count() == 5 and g.edges().filter("type = 'CHILD_OF'").count() == 2


def test_a_key_with_most_rows_is_spread(spark):
    edges = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("Concept:C").alias("target"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = ad.store(edges.withColumnRenamed("source", "id"), edges, lambda name, df: df)
        sizes = [r["count"] for r in stored.by_target.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert sum(sizes) == 4000 and max(sizes) < 2000
