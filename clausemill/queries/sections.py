"""Queries over headings, sections, trees and clauses.  Lines are made of order items: an order is a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators import clauses as cl
from clausemill.operators import structure as st
from clausemill.queries.base import table

#: Line texts by (l_partkey + 3 x l_linenumber) mod 12, as SQL that both engines read alike.
_RAW = """CASE CAST((l_partkey + l_linenumber * 3) % 12 AS INT)
 WHEN 0 THEN concat('<!-- Page ', l_linenumber, ' -->') WHEN 1 THEN concat('## PART ', l_suppkey % 9 + 1, ': Scope')
 WHEN 2 THEN concat('## ', l_partkey % 120, '. Title ', l_returnflag) WHEN 3 THEN concat('## ', l_linenumber, '.', l_suppkey % 9, ' Sub ', l_linestatus)
 WHEN 4 THEN concat('## ', l_linenumber, '.', l_suppkey % 9, '.', l_partkey % 5, ' Deep') WHEN 5 THEN concat('## (', substr('abcde', CAST(l_partkey % 5 AS INT) + 1, 1), ') item text')
 WHEN 6 THEN concat('## Table ', l_linenumber, ': rates') WHEN 7 THEN concat('## Note: see ', l_suppkey) WHEN 8 THEN '## Mystery heading'
 WHEN 9 THEN '' WHEN 10 THEN concat('body ', l_partkey) ELSE '## Annex details' END"""
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stem"), turn.cast("long").alias("line_no"), F.expr(_RAW).alias("raw"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.build_structure(_lines(spark, sf_dir))


def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_replace("raw", "^## ", "")
    return _lines(spark, sf_dir).groupBy(line.alias("line")).agg(F.count("*").alias("n")).withColumn("heading", tx.is_heading(F.col("line")))


def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).select(F.regexp_replace("raw", "^## ", "").alias("line")).distinct()
    return x.withColumn("c", tx.classify_heading(F.col("line"))).select("line", "c.type", "c.number", "c.title", "c.text")


def page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mark_lines(_lines(spark, sf_dir)).select("stem", "line_no", "page", F.col("event").cast("long").alias("event"), "is_page")


def section_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.heading_events(st.mark_lines(_lines(spark, sf_dir))).select("stem", "ord", "raw_heading", "page_start", "page_end", "body")


def ambiguous_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ambiguous(st.heading_events(st.mark_lines(_lines(spark, sf_dir))))


def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


def structure_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with order found in two levels, three lines or headings to a segment."""
    return st.build_structure(_lines(spark, sf_dir), segment=3)


def trail_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trail by the same scan, over segments of two nodes."""
    return st.trails(_nodes(spark, sf_dir), segment=2).select("stem", "ord", "trail")


def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.leaves(_nodes(spark, sf_dir)).select("stem", "ord", "type")


def operative_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.operative_units(_nodes(spark, sf_dir)).select("stem", "ord", "type", "text")


def node_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.trails(_nodes(spark, sf_dir)).select("stem", "ord", "trail")


def clause_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as clauses: repeated numbers get suffixes."""
    x = table(spark, sf_dir, "lineitem").withColumn("number", F.concat_ws(".", "l_linenumber", (F.col("l_suppkey") % 3)))
    return cl.number_clauses(x, _ORDER, "l_orderkey").groupBy("l_orderkey", "clause_id").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def clause_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame([("R", "Returned"), ("A", "Accepted")], "token string, label string")
    nodes = _nodes(spark, sf_dir).withColumn("domain", F.when(F.col("ord") % 4 == 0, "Returned").when(F.col("ord") % 4 == 1, "Accepted").when(F.col("ord") % 4 == 2, "Elsewhere"))
    return cl.export_clauses(nodes, domains).select("stem", "ord", "clause_id", "clause_no", "title", "text", "page_reference", F.col("semantic.domain").alias("domain"))


def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame([("R", "Returned")], "token string, label string")
    return cl.clause_counts(cl.export_clauses(_nodes(spark, sf_dir), domains))


QUERIES = {f.__name__: f for f in (heading_detect, heading_classify, page_fill, section_body, ambiguous_context, structure_nodes, structure_segments, leaf_nodes, operative_units, node_trail, trail_segments, clause_numbering, clause_export, clause_counts)}


def _kind(h: str) -> dict[str, str]:
    """SQL of type, number, title and text of a heading."""
    pats = {"table": tx.TABLE, "annex": tx.ANNEX, "part": tx.PART, "subsection": tx.SUBSECTION, "section": tx.SECTION}
    case = lambda f, end="NULL": "CASE " + " ".join(f"WHEN regexp_matches({h}, '{p}') THEN {f(k, p)}" for k, p in pats.items()) + f" WHEN regexp_matches({h}, '{tx.CLAUSE}') THEN {f('clause', tx.CLAUSE)} WHEN regexp_matches({h}, '{tx.FOOTNOTE}') THEN {f('footnote', tx.FOOTNOTE)} ELSE {end} END"
    return {
        "type": case(lambda k, p: f"'{k}'"),
        "number": case(lambda k, p: "NULL" if k == "footnote" else f"nullif(regexp_extract({h}, '{p}', 1), '')"),
        "title": case(lambda k, p: "NULL" if k in ("clause", "footnote") else f"nullif(trim(regexp_extract({h}, '{p}', 2)), '')"),
        "text": case(lambda k, p: f"trim(regexp_extract({h}, '{p}', {2 if k == 'clause' else 1}))" if k in ("clause", "footnote") else "NULL"),
    }


_L = f"l AS (SELECT l_orderkey AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS line_no, {_RAW} AS raw FROM lineitem)"
_K = _kind("raw_heading")
_EVENTS = f"""{_L}, m AS (SELECT *, TRY_CAST(nullif(regexp_extract(trim(raw), '{st.PAGE_MARK}', 1), '') AS INTEGER) AS mark, CASE WHEN regexp_matches(raw, '{st.HEADING_MARK}') THEN trim(regexp_extract(raw, '{st.HEADING_MARK}', 1)) END AS heading FROM l),
r AS (SELECT stem, line_no, raw, heading, mark IS NOT NULL AS is_page, coalesce(last_value(mark IGNORE NULLS) OVER w, 1) AS page, count(heading) OVER w AS event FROM m WINDOW w AS (PARTITION BY stem ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
e AS (SELECT stem, event AS ord, max(heading) AS raw_heading, min(page) FILTER (heading IS NOT NULL) AS page_start, coalesce(arg_max(page, line_no) FILTER (NOT is_page AND heading IS NULL), min(page) FILTER (heading IS NOT NULL)) AS page_end, string_agg(trim(raw), chr(10) ORDER BY line_no) FILTER (NOT is_page AND heading IS NULL AND trim(raw) <> '') AS body FROM r WHERE event > 0 GROUP BY stem, event)"""
_N = f"""{_EVENTS}, c AS (SELECT *, {_K['type']} AS t0, {_K['number']} AS number, {_K['title']} AS title, {_K['text']} AS own FROM e),
n0 AS (SELECT stem, ord, coalesce(t0, 'clause') AS type, number, title AS heading, CASE WHEN coalesce(t0, 'clause') IN ('clause', 'table', 'footnote') THEN coalesce(nullif(CASE WHEN t0 IS NULL THEN raw_heading ELSE own END, ''), body) ELSE body END AS text, page_start, page_end FROM c),
n1 AS (SELECT *, CASE WHEN type IN ('part', 'annex') THEN 1 WHEN type = 'section' THEN 2 WHEN type = 'subsection' THEN 2 + greatest(1, length(coalesce(number, '')) - length(replace(coalesce(number, ''), '.', ''))) WHEN type = 'clause' THEN 1001 END AS rk FROM n0),
n AS (SELECT a.stem, a.ord, CASE WHEN a.type NOT IN ('part', 'annex') THEN max(b.ord) END AS parent_ord, any_value(a.type) AS type, any_value(a.number) AS number, any_value(a.heading) AS heading, any_value(a.text) AS text, any_value(a.page_start) AS page_start, any_value(a.page_end) AS page_end FROM n1 a LEFT JOIN n1 b ON a.stem = b.stem AND b.ord < a.ord AND b.rk < coalesce(a.rk, 1002) GROUP BY a.stem, a.ord, a.type)"""
_LINE = "regexp_replace(raw, '^## ', '')"
_EXPORT = f"""{_N}, x AS (SELECT *, 'clause_' || replace(number, '.', '_') AS base, row_number() OVER (PARTITION BY stem, number ORDER BY ord) AS k FROM n WHERE type IN ('section', 'subsection', 'clause') AND regexp_matches(number, '{tx.CLAUSE_NUMBER}') AND (contains(number, '.') OR number::HUGEINT < 100))"""

ORACLES = {
    "heading_detect": f"WITH {_L} SELECT {_LINE} AS line, count(*) AS n, length(trim({_LINE})) BETWEEN 1 AND 100 AND (regexp_matches(trim({_LINE}), '{tx.HEADING_WORD}') OR regexp_matches(trim({_LINE}), '{tx.HEADING_NUMBER}') OR regexp_matches(trim({_LINE}), '{tx.HEADING_CAPS}')) AS heading FROM l GROUP BY ALL",
    "heading_classify": f"WITH {_L}, e AS (SELECT DISTINCT {_LINE} AS raw_heading FROM l) SELECT raw_heading AS line, " + ", ".join(f"{v} AS {k}" for k, v in _K.items()) + " FROM e",
    "page_fill": f"WITH {_EVENTS} SELECT stem, line_no, page, event, is_page FROM r",
    "section_body": f"WITH {_EVENTS} SELECT * FROM e",
    "ambiguous_context": f"WITH {_EVENTS}, t AS (SELECT *, {_K['type']} AS t FROM e), p AS (SELECT *, lag(t) OVER (PARTITION BY stem ORDER BY ord) AS prev_type FROM t) SELECT stem, ord, raw_heading, prev_type, substring(replace(coalesce(body, ''), chr(10), ' '), 1, 150) AS following_text FROM p WHERE t IS NULL",
    "structure_nodes": f"WITH {_N} SELECT * FROM n",
    "leaf_nodes": f"WITH {_N} SELECT stem, ord, type FROM n WHERE (stem, ord) NOT IN (SELECT (stem, parent_ord) FROM n WHERE parent_ord IS NOT NULL)",
    "operative_units": f"WITH {_N}, p AS (SELECT DISTINCT stem, parent_ord FROM n WHERE parent_ord IS NOT NULL) SELECT n.stem, ord, type, text FROM n LEFT JOIN p ON n.stem = p.stem AND n.ord = p.parent_ord WHERE coalesce(text, '') <> '' AND (type = 'clause' OR p.stem IS NULL OR type IN ('section', 'subsection') AND coalesce(number, '') <> '')",
    "node_trail": f"WITH RECURSIVE {_N}, y AS (SELECT stem, ord, parent_ord, trim(type || ' ' || coalesce(number, '') || ' ' || coalesce(heading, '')) AS entry FROM n), up AS (SELECT stem, ord, parent_ord AS above, '' AS trail FROM y UNION ALL SELECT up.stem, up.ord, y.parent_ord, CASE WHEN trail = '' THEN y.entry ELSE y.entry || ' > ' || trail END FROM up JOIN y ON up.stem = y.stem AND up.above = y.ord) SELECT stem, ord, CASE WHEN trail = '' THEN '(document root)' ELSE trail END AS trail FROM up WHERE up.above IS NULL",
    "clause_numbering": f"WITH x AS (SELECT *, l_linenumber || '.' || (l_suppkey % 3) AS number FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, number ORDER BY {', '.join(_ORDER)}) AS k FROM x) SELECT l_orderkey, 'clause_' || replace(number, '.', '_') || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS clause_id, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM y GROUP BY ALL",
    "clause_export": f"WITH {_EXPORT} SELECT stem, ord, base || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS clause_id, number AS clause_no, heading AS title, text, page_start AS page_reference, CASE ord % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'OTHER' END AS domain FROM x",
    "clause_counts": f"WITH {_EXPORT} SELECT stem, count(*) AS clause_count, count(*) FILTER (trim(coalesce(text, '')) = '') AS header_only, count(*) FILTER (trim(coalesce(text, '')) <> '') AS missed FROM x GROUP BY stem",
}
ORACLES |= {"structure_segments": ORACLES["structure_nodes"], "trail_segments": ORACLES["node_trail"]}
