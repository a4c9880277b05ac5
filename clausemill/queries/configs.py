"""Queries over layered configuration, vocabularies, checks, and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import values as v
from clausemill.operators import answer as an
from clausemill.operators import catalog as ct
from clausemill.operators import extract, interpret
from clausemill.queries.base import quoted, table
from clausemill.sources.readers import newest


def merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers over customers with the same nation as layers: the supplier row replaces the base row of its key."""
    base = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("key"), F.col("c_custkey").alias("position"), F.col("c_name").alias("label"))
    extra = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 11).alias("key"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("label"))
    return ct.merge_by_key(base, extra, "key", "position").select("key", "label", F.col("merged_position.__layer").alias("layer"), F.col("merged_position.p").alias("position"))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_name").alias("regulator"), F.concat(F.lit("N"), "n_nationkey").alias("code"))
    docs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), "n_name")).when(F.col("s_suppkey") % 3 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("regulator"))
    return ct.registry_pack(docs, registry, "GLOBAL").select("s_suppkey", "pack")


def coerce_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", v.allowed_or(raw, ["view", "click", "purchase"], "other").alias("kind"))


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"type in vocabulary": F.col("event_type").isin("view", "click", "signup"), "value below 50": F.col("value") < 50, "value above 1": F.col("value") > 1, "even user": F.col("user_id") % 2 == 0}
    x = ct.violations(table(spark, sf_dir, "events"), rules, keep=2)
    return x.filter("n_violations > 0").select("event_id", F.array_join("violations", "; ").alias("violations"), "n_violations")


#: An event as an object of a JSON schema.
EVENT = {
    "type": "array",
    "items": {
        "type": "object",
        "additionalProperties": False,
        "required": ["event_id", "event_type", "value"],
        "properties": {"event_id": {"type": "integer", "minimum": 100}, "event_type": {"type": "string", "enum": ["view", "click", "signup"], "maxLength": 5}, "value": {"type": "number", "minimum": 1, "maximum": 50}, "props": {"type": ["string", "null"], "pattern": "\\{"}},
    },
}


def json_schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against a JSON schema; every tenth has no value, every eleventh none of the type."""
    x = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), "props")
    bad = ct.violations(x, ct.schema_rules(EVENT, x.columns))
    return bad.filter("n_violations > 0").select("event_id", F.array_join("violations", "; ").alias("violations"), "n_violations")


def reply_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of events, by user and batch: what breaks the classifier's contract."""
    n = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stem"), (n % 2).cast("int").alias("batch"), (n % 20).cast("int").alias("index"), n.cast("int").alias("reply_ord"), F.col("event_type").alias("domain"), F.when(n % 13 == 0, F.repeat(F.lit("x"), 81)).alias("concept"), F.when(n % 3 == 0, " REPORT").otherwise("REPORT").alias("action"), F.lit(None).cast("string").alias("object"), F.lit("Reporting").alias("obligation_type"), F.lit("Mandatory").alias("mandatory_flag"), F.when(n % 7 == 0, "high").otherwise((F.col("value") / 20).cast("string")).alias("confidence_score"))
    return interpret.reply_errors(r, ["view", "click"]).select("stem", "batch", "error_count", F.array_join("errors", "; ").alias("errors"))


def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("status"))
    return extract.extraction_status(log)


def newest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "events"), "event_id", "ts")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") % 7
    text = F.concat("text", F.lit(" [DOC "), n.cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("] and [6, 7] [X 3.1] [1][2]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("answer"))


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.functions.text import citations

    return _answers(spark, sf_dir).select("conv_id", "turn", F.posexplode(citations(F.col("answer"))).alias("k", "c")).select("conv_id", "turn", "k", "c.document", "c.clause_no")


def ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", F.concat_ws(".", (F.col("conv_id") % 7).cast("string"), F.col("turn").cast("string")).alias("clause_no"))
    return an.ungrounded(_answers(spark, sf_dir), evidence, by=["conv_id"]).groupBy("conv_id", "citation").agg(F.count("*").alias("n"))


def reply_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classifier replies: the last reply of an index counts, odd values fall back."""
    n = F.col("event_id")
    replies = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stem"), F.lit(0).alias("batch"), (n % 20).cast("int").alias("index"), n.cast("int").alias("reply_ord"), F.col("event_type").alias("domain"), F.lit(None).cast("string").alias("concept"), F.when(n % 2 == 0, "REPORT").otherwise(" REPORT").alias("action"), F.lit(None).cast("string").alias("object"), F.when(n % 3 == 0, "Reporting").alias("obligation_type"), F.when(n % 5 == 0, "Mandatory").otherwise("mandatory").alias("mandatory_flag"), F.when(n % 7 == 0, "n/a").otherwise((F.col("value") / 20).cast("string")).alias("confidence_score"))
    return interpret.coerce(replies, ["click", "view"]).select("stem", "index", "domain", "action", "obligation_type", "mandatory_flag", F.round("confidence_score", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (reply_coercion, merge_override, registry_lookup, coerce_enum, schema_violations, json_schema_checks, reply_errors, extraction_status, newest_answer, citation_extract, ungrounded)}

_ANS = "a AS (SELECT conv_id, turn, text || ' [DOC ' || (conv_id % 7) || '.' || turn || '] and [6, 7] [X 3.1] [1][2]' AS answer FROM conversations)"
_CITE = r"\[([^\]\[]+?)\s+([0-9]+(?:\.[0-9]+)*)\]"
_C = f"c AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '{_CITE}', 1)) AS document, unnest(regexp_extract_all(answer, '{_CITE}', 2)) AS clause_no, unnest(range(len(regexp_extract_all(answer, '{_CITE}', 1)))) AS k FROM a)"
ORACLES = {
    "reply_coercion": """WITH r AS (SELECT user_id::VARCHAR AS stem, (event_id % 20)::INTEGER AS index, event_id AS n, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id DESC) = 1)
SELECT stem, index, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'Other' END AS domain, CASE WHEN n % 2 = 0 THEN 'REPORT' ELSE 'OTHER' END AS action, CASE WHEN n % 3 = 0 THEN 'Reporting' ELSE 'Other' END AS obligation_type, CASE WHEN n % 5 = 0 THEN 'Mandatory' ELSE 'Not Applicable' END AS mandatory_flag, CASE WHEN n % 7 <> 0 THEN round(greatest(0.0, least(1.0, value / 20)), 6) END AS confidence FROM r""",
    "merge_override": """WITH b AS (SELECT c_custkey % 700 AS key, c_custkey AS position, c_name AS label, 0 AS layer FROM customer UNION ALL SELECT s_suppkey * 11, s_suppkey, s_name, 1 FROM supplier)
SELECT key, arg_max(label, layer * 1000000000 + position) AS label, min(layer) AS layer, arg_min(position, layer * 1000000000 + position) AS position FROM b GROUP BY key""",
    "registry_lookup": "WITH d AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' ' || n_name WHEN 1 THEN lower(n_name) ELSE n_name END AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, coalesce('N' || n_nationkey, 'GLOBAL') AS pack FROM d LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON trim(r) = n_name",
    "coerce_enum": f"SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_type IN ({quoted(['view', 'click', 'purchase'])}) THEN event_type ELSE 'other' END AS kind FROM events",
    "schema_violations": "WITH x AS (SELECT event_id, list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'type in vocabulary' END, CASE WHEN NOT value < 50 THEN 'value below 50' END, CASE WHEN NOT value > 1 THEN 'value above 1' END, CASE WHEN user_id % 2 <> 0 THEN 'even user' END], lambda y: y IS NOT NULL) AS f FROM events) SELECT event_id, array_to_string(f[1:2], '; ') AS violations, len(f)::INTEGER AS n_violations FROM x WHERE len(f) > 0",
    "json_schema_checks": "WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value, props FROM events), x AS (SELECT event_id, list_filter([CASE WHEN event_id < 100 THEN 'event_id: minimum' END, CASE WHEN event_type IS NULL THEN 'event_type: required' END, CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'event_type: enum' END, CASE WHEN length(event_type) > 5 THEN 'event_type: maxLength' END, CASE WHEN value IS NULL THEN 'value: required' END, CASE WHEN value < 1 THEN 'value: minimum' END, CASE WHEN value > 50 THEN 'value: maximum' END, CASE WHEN NOT contains(props, '{') THEN 'props: pattern' END], lambda y: y IS NOT NULL) AS f FROM e) SELECT event_id, array_to_string(f[1:5], '; ') AS violations, len(f)::INTEGER AS n_violations FROM x WHERE len(f) > 0",
    "reply_errors": "WITH r AS (SELECT user_id::VARCHAR AS stem, (event_id % 2)::INTEGER AS batch, (event_id % 20)::INTEGER AS index, event_id, list_filter([CASE WHEN event_id % 13 = 0 THEN 'concept: maxLength' END, CASE WHEN event_id % 7 = 0 THEN 'confidence_score: type' END, CASE WHEN event_id % 7 = 0 THEN 'confidence_score: minimum' END, CASE WHEN event_id % 7 = 0 OR value / 20 > 1 THEN 'confidence_score: maximum' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'domain: enum' END, CASE WHEN event_id % 3 = 0 THEN 'action: enum' END], lambda y: y IS NOT NULL) AS f FROM events), e AS (SELECT stem, batch, index, event_id, len(f) AS n, unnest(f[1:5]) AS err, generate_subscripts(f[1:5], 1) AS k FROM r), g AS (SELECT stem, batch, list(index || '/' || err ORDER BY index, event_id, k) AS l FROM e GROUP BY stem, batch), c AS (SELECT stem, batch, sum(len(f))::BIGINT AS n FROM r WHERE len(f) > 0 GROUP BY stem, batch) SELECT stem, batch, n AS error_count, array_to_string(l[1:5], '; ') AS errors FROM g JOIN c USING (stem, batch)",
    "extraction_status": "SELECT user_id AS stem, CASE WHEN bool_and(event_type <> 'error') THEN 'Success' ELSE 'Partial' END AS extraction_status FROM events GROUP BY user_id",
    "newest_answer": "SELECT arg_max(event_id, ts) AS event_id FROM events",
    "citation_extract": f"WITH {_ANS}, {_C} SELECT conv_id, turn, k::INTEGER AS k, document, clause_no FROM c",
    "ungrounded": f"WITH {_ANS}, {_C}, e AS (SELECT conv_id, (conv_id % 7) || '.' || turn AS clause_no FROM conversations WHERE role = 'user') SELECT conv_id, '[' || document || ' ' || clause_no || ']' AS citation, count(*) AS n FROM c WHERE (conv_id, clause_no) NOT IN (SELECT (conv_id, clause_no) FROM e) GROUP BY ALL",
}
