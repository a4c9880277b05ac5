"""Queries over concept matching.  Part names are the catalog; variants of them are the free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions import values as v
from clausemill.operators import index as ix
from clausemill.operators import matching as mt
from clausemill.queries.base import table
from clausemill.queries.documents import sql_stem


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").cast("int").alias("cat_ord"))
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    slug = F.concat(F.lit("CPT_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return x.select("cat_ord", slug.alias("canonical_id"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("definition"), F.concat(F.lit("D"), F.col("cat_ord") % 5).alias("domain"), F.lit(None).cast("string").alias("parent"), F.when(F.col("cat_ord") % 3 == 0, "approved").otherwise("draft").alias("status"), F.array(F.concat_ws(" ", word(2), word(1)), F.concat("p_name", F.lit(" fitting assembly"))).alias("synonyms"))


def _concept() -> object:
    k, word = F.col("p_partkey") % 9, lambda n: F.element_at(F.split("p_name", " "), n)
    return (
        F.when(k == 0, F.col("p_name"))
        .when(k == 1, F.upper("p_name"))
        .when(k == 2, F.concat("p_name", F.lit(".;")))
        .when(k == 3, F.concat(F.lit("  "), word(1), F.lit("   "), word(2), F.lit(" ")))
        .when(k == 4, F.concat_ws(" ", word(2), word(1)))
        .when(k == 5, F.concat("p_name", F.lit("s unit fittings")))
        .when(k == 6, F.concat_ws(" ", F.lower("p_type"), word(2)))
        .when(k == 7, F.col("p_brand"))
        .otherwise(F.concat(word(1), F.lit(" assembly")))
    )


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    semantic = F.struct(F.concat(F.lit("T"), F.col("p_partkey") % 6).alias("domain"), _concept().alias("concept"), none.alias("action"), none.alias("object"), none.alias("obligation_type"), none.alias("mandatory_flag"), F.lit(0.5).alias("confidence_score"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("stem"), F.col("p_partkey").alias("ord"), F.concat(F.lit("clause_"), "p_partkey").alias("clause_id"), F.col("p_partkey").cast("string").alias("clause_no"), semantic.alias("semantic"))


def _domains(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("T"), "id").alias("token"), F.concat(F.lit("D"), "id").alias("label"))


def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "part").select(_concept().alias("concept")).distinct()
    return concepts.select("concept", tx.tight(F.col("concept")).alias("tight"), tx.loose(F.col("concept")).alias("loose"))


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "part").select(_concept().alias("concept")).distinct()
    return mt.fuzzy_best(concepts, catalog(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "part").select(_concept().alias("concept")).distinct()
    return mt.match_concepts(concepts, catalog(spark, sf_dir))


def ontology_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mt.ontology_objects(_clauses(spark, sf_dir), catalog(spark, sf_dir), _domains(spark))
    return x.select("stem", "ord", "canonical_id", "canonical_label", "domain", "match_type", "match_confidence", "review_required")


def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.coverage(mt.ontology_objects(_clauses(spark, sf_dir), catalog(spark, sf_dir), _domains(spark)))


def unmapped_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.unmapped_concepts(mt.ontology_objects(_clauses(spark, sf_dir), catalog(spark, sf_dir), _domains(spark)))


def suggestion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of part rows: ids that exist or not, confidences that are numbers or not."""
    slug = F.concat(F.lit("CPT_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    replies = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.when(F.col("p_partkey") % 4 == 0, "CPT_NONE").otherwise(slug).alias("canonical_id"), F.when(F.col("p_partkey") % 5 == 0, "high").otherwise((F.col("p_size") / 40).cast("string")).alias("confidence"), F.col("p_partkey").alias("reply_ord"))
    x = mt.accepted_suggestions(replies, catalog(spark, sf_dir))
    return x.withColumnRenamed("__for", "concept")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hook might say of the concepts: an entry for each, with a confidence that is a number or not."""
    slug = F.concat(F.lit("CPT_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(spark, sf_dir, "part").select(_concept().alias("concept"), slug.alias("canonical_id"), F.when(F.col("p_partkey") % 5 == 0, "high").otherwise((F.col("p_size") / 40).cast("string")).alias("confidence"), F.col("p_partkey").alias("reply_ord"))


def ontology_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped clauses with the suggestions for those that stay unmapped."""
    x = mt.ontology_objects(_clauses(spark, sf_dir), catalog(spark, sf_dir), _domains(spark), suggestions=_replies(spark, sf_dir))
    return x.select("stem", "ord", "canonical_id", "suggested_canonical_id", "suggested_label", "suggestion_confidence")


def enriched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of each clause: title, text, concept and object, as far as they are there."""
    x = _clauses(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("text")), "ord")
    return x.select("ord", ix.enriched_text().alias("indexed"))


def clamp_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, "x").when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise((F.col("value") / 10 - 1).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", v.confidence(raw, 3).alias("confidence"))


QUERIES = {f.__name__: f for f in (normalize_match, fuzzy_match, concept_match, ontology_objects, match_coverage, unmapped_concepts, suggestion_filter, ontology_suggestions, enriched_text, clamp_confidence)}

SQL_CATALOG = """n AS (SELECT p_name, min(p_partkey) AS cat_ord FROM part GROUP BY p_name),
cat AS (SELECT cat_ord, 'CPT_' || upper(replace(p_name, ' ', '_')) AS canonical_id, p_name AS label, 'D' || (cat_ord % 5) AS domain, CASE WHEN cat_ord % 3 = 0 THEN 'approved' ELSE 'draft' END AS status, [split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), p_name || ' fitting assembly'] AS synonyms FROM n),
forms AS (SELECT canonical_id, cat_ord, 0 AS pos, label AS form FROM cat UNION ALL SELECT canonical_id, cat_ord, k, synonyms[k] FROM cat, range(1, 3) t(k))"""
_SQL_CONCEPT = """CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || '.;' WHEN 3 THEN '  ' || split_part(p_name, ' ', 1) || '   ' || split_part(p_name, ' ', 2) || ' ' WHEN 4 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 5 THEN p_name || 's unit fittings' WHEN 6 THEN lower(p_type) || ' ' || split_part(p_name, ' ', 2) WHEN 7 THEN p_brand ELSE split_part(p_name, ' ', 1) || ' assembly' END"""
_TIGHT = "regexp_replace(trim(lower({0})), '\\s+', ' ', 'g')"
_LOOSE = "trim(regexp_replace(" + _TIGHT + ", '[.,;:''\"]+$', ''))"
_WORDS = "list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1), lambda t: " + sql_stem("t") + ")"
_SQL_MATCH = f"""{SQL_CATALOG}, c AS (SELECT DISTINCT {_SQL_CONCEPT} AS concept FROM part),
ft AS (SELECT cat_ord, pos, canonical_id, token, count(*) AS tf FROM (SELECT cat_ord, pos, canonical_id, unnest({_WORDS.format('form')}) AS token FROM forms) GROUP BY ALL),
fi AS (SELECT token, ln(((SELECT count(*) FROM (SELECT DISTINCT cat_ord, pos FROM ft)) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM ft GROUP BY token),
fv AS (SELECT cat_ord, pos, canonical_id, token, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY cat_ord, pos)) AS w FROM ft JOIN fi USING (token)),
ct AS (SELECT concept, token, count(*) AS tf FROM (SELECT concept, unnest({_WORDS.format('concept')}) AS token FROM c) GROUP BY ALL),
cv AS (SELECT concept, token, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY concept)) AS w FROM ct JOIN fi USING (token)),
sim AS (SELECT concept, cat_ord, pos, canonical_id, round(sum(cv.w * fv.w), 12) AS similarity FROM cv JOIN fv USING (token) GROUP BY ALL),
fz AS (SELECT concept, canonical_id AS fuzzy_id, similarity FROM sim QUALIFY row_number() OVER (PARTITION BY concept ORDER BY similarity DESC, cat_ord, pos) = 1),
tl AS (SELECT {_TIGHT.format('form')} AS k, arg_max(canonical_id, cat_ord * 10 + pos) AS id FROM forms WHERE pos = 0 GROUP BY 1),
ts AS (SELECT {_TIGHT.format('form')} AS k, arg_max(canonical_id, cat_ord * 10 + pos) AS id FROM forms WHERE pos > 0 GROUP BY 1),
lo AS (SELECT {_LOOSE.format('form')} AS k, arg_max(canonical_id, cat_ord * 10 + pos) AS id FROM forms GROUP BY 1),
m AS (SELECT c.concept, coalesce(tl.id, ts.id, lo.id, CASE WHEN similarity >= 0.62 THEN fuzzy_id END) AS canonical_id,
 CASE WHEN tl.id IS NOT NULL THEN 'exact_label' WHEN ts.id IS NOT NULL THEN 'synonym' WHEN lo.id IS NOT NULL THEN 'normalized' WHEN similarity >= 0.62 THEN 'fuzzy' ELSE 'unmapped' END AS match_type,
 CASE WHEN tl.id IS NOT NULL THEN 1.0::DOUBLE WHEN ts.id IS NOT NULL THEN 0.95 WHEN lo.id IS NOT NULL THEN 0.85 WHEN similarity >= 0.62 THEN round(least(similarity, 0.85::DOUBLE), 3) ELSE 0.0 END AS base_confidence
 FROM c LEFT JOIN tl ON {_TIGHT.format('c.concept')} = tl.k LEFT JOIN ts ON {_TIGHT.format('c.concept')} = ts.k LEFT JOIN lo ON {_LOOSE.format('c.concept')} = lo.k LEFT JOIN fz ON fz.concept = c.concept)"""
_SQL_OBJECTS = f"""{_SQL_MATCH}, k AS (SELECT p_brand AS stem, p_partkey AS ord, {_SQL_CONCEPT} AS concept, CASE WHEN p_partkey % 6 < 5 THEN 'D' || (p_partkey % 6) END AS domain FROM part),
o0 AS (SELECT k.*, m.canonical_id, match_type, base_confidence, cat.label AS canonical_label, status, m.canonical_id IS NOT NULL AND coalesce(k.domain <> cat.domain, false) AS differs FROM k JOIN m USING (concept) LEFT JOIN cat ON m.canonical_id = cat.canonical_id),
o1 AS (SELECT *, CASE WHEN differs THEN greatest(0.0, base_confidence - 0.2) ELSE base_confidence END AS sure FROM o0),
o AS (SELECT stem, ord, concept, canonical_id, canonical_label, domain, match_type, round(sure, 3) AS match_confidence, canonical_id IS NULL OR status = 'draft' OR sure < 0.9 OR differs AS review_required FROM o1)"""

ORACLES = {
    "normalize_match": f"WITH c AS (SELECT DISTINCT {_SQL_CONCEPT} AS concept FROM part) SELECT concept, {_TIGHT.format('concept')} AS tight, {_LOOSE.format('concept')} AS loose FROM c",
    "fuzzy_match": f"WITH {_SQL_MATCH} SELECT concept, fuzzy_id, round(similarity, 6) AS similarity FROM fz",
    "concept_match": f"WITH {_SQL_MATCH} SELECT * FROM m",
    "ontology_objects": f"WITH {_SQL_OBJECTS} SELECT stem, ord, canonical_id, canonical_label, domain, match_type, match_confidence, review_required FROM o",
    "match_coverage": f"WITH {_SQL_OBJECTS} SELECT stem, count(*) AS total, count(canonical_id) AS mapped, count(*) - count(canonical_id) AS unmapped, round(100.0 * count(canonical_id) / count(*), 1) AS coverage_pct, count(*) FILTER (review_required) AS review_required, 0::BIGINT AS suggested FROM o GROUP BY stem",
    "unmapped_concepts": f"WITH {_SQL_OBJECTS} SELECT DISTINCT concept FROM o WHERE canonical_id IS NULL",
    "suggestion_filter": f"""WITH {SQL_CATALOG}, r AS (SELECT p_brand AS concept, CASE WHEN p_partkey % 4 = 0 THEN 'CPT_NONE' ELSE 'CPT_' || upper(replace(p_name, ' ', '_')) END AS canonical_id, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 40 END AS conf, p_partkey FROM part)
SELECT concept, canonical_id AS suggested_canonical_id, label AS suggested_label, round(greatest(0, least(1, conf)), 3) AS suggestion_confidence FROM r JOIN cat USING (canonical_id) WHERE conf >= 0.5 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY p_partkey DESC) = 1""",
    "ontology_suggestions": f"""WITH {_SQL_OBJECTS}, r AS (SELECT {_SQL_CONCEPT} AS concept, 'CPT_' || upper(replace(p_name, ' ', '_')) AS canonical_id, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 40 END AS conf, p_partkey FROM part),
b AS (SELECT concept, canonical_id, label, round(greatest(0, least(1, conf)), 3) AS conf FROM r JOIN cat USING (canonical_id) WHERE conf >= 0.5 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY p_partkey DESC) = 1)
SELECT stem, ord, o.canonical_id, b.canonical_id AS suggested_canonical_id, b.label AS suggested_label, conf AS suggestion_confidence FROM o LEFT JOIN b ON o.canonical_id IS NULL AND o.concept = b.concept""",
    "enriched_text": f"SELECT p_partkey AS ord, concat_ws(' ', nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), CASE WHEN p_partkey % 4 <> 0 THEN nullif(p_type, '') END, nullif({_SQL_CONCEPT}, '')) AS indexed FROM part",
    "clamp_confidence": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(greatest(0.0, least(1.0, value / 10 - 1)), 3) END AS confidence FROM events",
}
