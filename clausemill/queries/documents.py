"""Queries over the texts of documents: words, lines, cleaning, statistics, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.python import similar, similarity_ratio
from clausemill.operators import clauses as cl
from clausemill.operators import extract
from clausemill.operators.scan import following
from clausemill.queries.base import sql_tokens, table
from clausemill.queries.sections import _ORDER


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.lit(1).alias("page_no"), "text")


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts by stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(tx.concept_tokens(F.col("text"), stemmed=False)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return words.groupBy(tx.stem(F.col("t")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


def denoise_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by what the garble filter says."""
    words = F.explode(F.split("text", r"(?U)\s+")).alias("token")
    return table(spark, sf_dir, "documents").select(words).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")).select("token", "n", tx.is_clean_token(F.col("token")).alias("clean"))


def denoise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.denoise_stats(extract.split_lines(table(spark, sf_dir, "documents").select("source", "text")), ["source"])


def denoise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document: its lines, characters and a digest."""
    lines = extract.denoise_lines(extract.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(ordered).alias("digest"))


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata step over documents as pages of their source, with a hook for the title and given values."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("stem"), F.col("doc_id").cast("int").alias("page_no"), "text")
    hook = lambda x: x.select("stem", F.concat(F.lit("About "), "stem").alias("title"), F.lit("").alias("business_domain"), F.length("text").cast("string").alias("version"))
    out = extract.metadata(pages, hook, {"regulator": "CB", "jurisdiction": ""}, max_chars=500)
    return out.select("stem", "title", "regulator", "jurisdiction", "business_domain", "version", "total_pages", "total_words", "total_characters", "total_images", "document_format", "extraction_status")


def first_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,000 characters of each source's documents in order, as a model would get them."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("stem"), F.col("doc_id").alias("page_no"), "text")
    return extract.first_chars(pages, 5000, segment=64).select("stem", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and arrays out of what surrounds them in a reply."""
    reply = F.concat(F.when(F.col("event_id") % 3 != 0, "Here: ").otherwise(""), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), "props", F.lit("] done"))).otherwise(F.col("props")), F.when(F.col("event_id") % 5 == 0, " end").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", tx.json_tail(reply).alias("tail"), tx.json_array(reply).alias("list"))


def scan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.likely_scanned(_pages(spark, sf_dir))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.document_stats(_pages(spark, sf_dir)).withColumnRenamed("stem", "doc")


def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.file_hash("text").alias("file_hash"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one page of markdown: its length, lines and headings."""
    return extract.markdown_text(extract.markdown_lines(_pages(spark, sf_dir))).select("stem", F.length("markdown").alias("n_chars"), "total_sections", F.md5("markdown").alias("digest"))


def latin1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("“€ ₹5…—"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.latin1(odd)).alias("digest"))


def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda n: F.md5(F.substring("text", 1, n)).alias(f"first_{n}")
    return table(spark, sf_dir, "documents").select("doc_id", cut(150), cut(800), cut(8000))


def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each order in batches of three."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER)
    return cl.batch_ids(items, _ORDER, 3, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "batch", "index")


def near_duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text against that of the next id, gaps or not: whether their matching-blocks ratio is above 0.85, and the ratio where it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = following(docs.select("doc_id"), "doc_id", "doc_id").filter("next IS NOT NULL")
    texts = docs.select(F.col("doc_id").alias("next"), F.col("text").alias("b"))
    both = pairs.join(docs.withColumnRenamed("text", "a"), "doc_id").join(texts, "next").withColumn("similar", similar(F.col("a"), F.col("b"), 0.85))
    ratio = similarity_ratio(F.when(F.col("similar"), F.col("a")), F.when(F.col("similar"), F.col("b")))
    return both.select("doc_id", F.col("next").alias("next_id"), "similar", F.when(F.col("similar"), F.round(ratio, 6)).alias("ratio"))


QUERIES = {f.__name__: f for f in (tokenize_counts, stem_tokens, denoise_tokens, denoise_stats, denoise_lines, metadata_rows, first_chars, json_parts, scan_check, doc_stats, doc_sha256, markdown_sections, latin1_text, truncations, batch_ids, near_duplicate_ratio)}

_EDGES = "[" + "".join("\\" + c if c.isascii() else c for c in tx.EDGES) + "]"
#: Unicode white space, which the engine's patterns mean.
_WS = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"


def sql_clean(t: str) -> str:
    """The garble filter for a token."""
    edges = _EDGES.replace("'", "''")
    core = f"regexp_replace(regexp_replace({t}, '^{edges}+', ''), '{edges}+$', '')"
    letters, symbols = f"regexp_replace({core}, '[^\\p{{L}}]', '', 'g')", f"length(regexp_replace({core}, '[\\p{{L}}\\p{{N}}]', '', 'g'))"
    garble = "regexp_matches({0}, '[~\\\\|^`{{}}<>_=#*\\x{{fffd}}]') OR contains({0}, '..')".format(t)
    return f"""CASE WHEN {garble} OR length({core}) = 0 THEN false
 WHEN length({letters}) = 0 THEN regexp_matches({core}, '\\p{{Nd}}') AND {symbols} <= 2
 WHEN {symbols} >= 3 OR length({letters}) / length({core}) < 0.5 THEN false
 WHEN length({letters}) = 1 THEN {core} IN ('a', 'A', 'I', 'i')
 WHEN length({letters}) >= 3 AND NOT regexp_matches({letters}, '[aeiouyAEIOUY]') THEN {letters} = upper({letters}) AND {letters} <> lower({letters}) AND length({letters}) <= 5
 ELSE true END"""


def sql_stem(t: str) -> str:
    whens = " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) >= {len(s) + 3} THEN left({t}, length({t}) - {len(s)}) || '{'y' if s == 'ies' else ''}'" for s in tx.SUFFIXES)
    return f"CASE WHEN length({t}) <= 4 THEN {t} {whens} ELSE {t} END"


_TRIM = f"regexp_replace(regexp_replace(raw, '^{_WS}+', ''), '{_WS}+$', '')"


def _lines(keys: str) -> str:
    parts = f"regexp_split_to_array(regexp_replace(text, '{_BREAK}$', ''), '{_BREAK}')"
    return f"l AS (SELECT {keys}, unnest({parts}) AS raw, generate_subscripts({parts}, 1) AS k FROM documents WHERE text <> '')"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}+'), lambda x: x <> '')"


_HEADING = f"length(s) > 0 AND length(s) <= 100 AND (regexp_matches(s, '{tx.HEADING_WORD}') OR regexp_matches(s, '{tx.HEADING_NUMBER}') OR regexp_matches(s, '{tx.HEADING_CAPS}'))"

ORACLES = {
    "tokenize_counts": f"SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_distinct FROM (SELECT doc_id, {sql_tokens('coalesce(text, chr(32))')} AS w FROM documents)",
    "stem_tokens": f"WITH w AS (SELECT unnest(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'), lambda t: length(t) > 1)) AS t FROM documents), c AS (SELECT t, count(*) AS n FROM w GROUP BY t) SELECT {sql_stem('t')} AS stem, sum(n)::BIGINT AS n, count(*) AS forms FROM c GROUP BY 1",
    "denoise_tokens": f"WITH w AS (SELECT unnest({_tokens('text')}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY token) SELECT token, n, {sql_clean('token')} AS clean FROM c",
    "denoise_stats": f"WITH {_lines('source')}, k AS (SELECT source, len(w) AS n, len(list_filter(w, lambda t: {sql_clean('t')})) AS k FROM (SELECT source, {_tokens('raw')} AS w FROM l)) SELECT source, count(*) AS lines_in, count(*) FILTER (n > 0 AND k = 0) AS lines_dropped, sum(n)::BIGINT AS tokens_in, sum(n - k)::BIGINT AS tokens_dropped FROM k GROUP BY source",
    "denoise_lines": f"WITH {_lines('doc_id')}, w AS (SELECT doc_id, k, {_tokens('raw')} AS w FROM l), c AS (SELECT doc_id, k, w, list_filter(w, lambda t: {sql_clean('t')}) AS c FROM w) SELECT doc_id, count(*) AS n_lines, md5(string_agg(array_to_string(c, ' '), chr(10) ORDER BY k)) AS digest FROM c WHERE len(c) > 0 OR len(w) = 0 GROUP BY doc_id",
    "metadata_rows": f"WITH t AS (SELECT source AS stem, count(*) AS n, sum(len({_tokens('text')})) AS w, sum(length(coalesce(text, ''))) + 2 * (count(*) - 1) AS c FROM documents GROUP BY source) SELECT stem, 'About ' || stem AS title, 'CB' AS regulator, NULL::VARCHAR AS jurisdiction, 'Unknown' AS business_domain, least(c, 500)::BIGINT::VARCHAR AS version, n AS total_pages, w::BIGINT AS total_words, c::BIGINT AS total_characters, 0::BIGINT AS total_images, 'PDF' AS document_format, 'Success' AS extraction_status FROM t",
    "first_chars": "WITH t AS (SELECT source AS stem, doc_id, coalesce(text, '') AS text, sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM documents), x AS (SELECT stem, substring(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 1, 5000) AS text FROM t WHERE coalesce(pos, 0) < 5002 GROUP BY stem) SELECT stem, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM x",
    "json_parts": "WITH r AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'Here: ' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN '[' || props || '] done' ELSE props END || CASE WHEN event_id % 5 = 0 THEN ' end' ELSE '' END AS t FROM events) SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0 THEN regexp_extract(t, '\\{.*$') END AS tail, nullif(regexp_extract(t, '\\[.*\\]'), '') AS list FROM r",
    "scan_check": "SELECT doc_id::VARCHAR AS stem, 1::BIGINT AS n_pages, length(coalesce(text, ''))::BIGINT AS n_chars, length(coalesce(text, '')) < 200 AS scanned FROM documents",
    "doc_stats": f"SELECT doc_id::VARCHAR AS doc, 1::BIGINT AS total_pages, len({_tokens('text')})::BIGINT AS total_words, length(text)::BIGINT AS total_characters, 0::BIGINT AS total_images FROM documents",
    "doc_sha256": "SELECT doc_id, 'sha256:' || sha256(text) AS file_hash FROM documents",
    "markdown_sections": f"""WITH d AS (SELECT doc_id FROM documents), {_lines('doc_id')},
x AS (SELECT doc_id, k, regexp_replace(raw, '{_WS}+$', '') AS r, {_TRIM} AS s FROM l),
y AS (SELECT doc_id, k, CASE WHEN {_HEADING} THEN chr(10) || '## ' || s || chr(10) ELSE r END AS line, CASE WHEN {_HEADING} THEN 1 ELSE 0 END AS h FROM x),
z AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS body, sum(h) AS h FROM y GROUP BY doc_id),
m AS (SELECT d.doc_id, '<!-- Page 1 -->' || coalesce(chr(10) || body, '') || chr(10) AS markdown, coalesce(h, 0)::BIGINT AS h FROM d LEFT JOIN z USING (doc_id))
SELECT doc_id::VARCHAR AS stem, length(markdown)::INTEGER AS n_chars, h AS total_sections, md5(markdown) AS digest FROM m""",
    "latin1_text": "SELECT doc_id, md5(regexp_replace(replace(replace(translate('“€ ₹5…—' || text, '‘’“”–—•' || chr(160), chr(39) || chr(39) || '\"\"--- '), '…', '...'), '₹', 'Rs.'), '[^\\x{00}-\\x{ff}]', '?', 'g')) AS digest FROM documents",
    "truncations": "SELECT doc_id, " + ", ".join(f"md5(substring(text, 1, {n})) AS first_{n}" for n in (150, 800, 8000)) + " FROM documents",
    "batch_ids": f"SELECT l_orderkey, l_linenumber, l_partkey, (k // 3)::INTEGER AS batch, (k % 3)::INTEGER AS index FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS k FROM lineitem)",
}
