"""Free-text concepts to catalog entries: label, synonym, loose form, then idf-weighted cosine of stemmed words.

Equal concepts are matched once.  The cosine is an equi-join on words with the catalog's forms, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions import values as v


@dataclass(frozen=True)
class Rules:
    """Confidences, floors and review rules of the matcher."""

    exact_label: float = 1.0
    synonym: float = 0.95
    normalized: float = 0.85
    min_similarity: float = 0.62
    max_confidence: float = 0.85
    auto_accept: float = 0.90
    mismatch_penalty: float = 0.2
    penalize_mismatch: bool = True
    draft_needs_review: bool = True
    fuzzy: bool = True
    stemmed: bool = True
    suggestion_batch: int = 40
    suggestion_floor: float = 0.5


def surface_forms(catalog: DataFrame) -> DataFrame:
    """canonical_id, cat_ord, pos (0 is the label), form."""
    forms = F.posexplode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return catalog.select("canonical_id", "cat_ord", forms.alias("pos", "form"))


def form_vectors(forms: DataFrame, stemmed: bool = True) -> DataFrame:
    """cat_ord, pos, canonical_id, token, weight (unit length), idf.  A form counts once for each word; forms without words do not count."""
    words = forms.select("cat_ord", "pos", "canonical_id", F.explode(tx.concept_tokens(F.col("form"), stemmed)).alias("token"))
    tf = words.groupBy("cat_ord", "pos", "canonical_id", "token").agg(F.count("*").alias("tf"))
    n = tf.select("cat_ord", "pos").distinct().agg(F.count("*").alias("n")).scalar()
    idf = tf.groupBy("token").agg(F.count("*").alias("df")).select("token", v.idf(n, F.col("df")).alias("idf"))
    weighted = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("cat_ord", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, ["cat_ord", "pos"]).select("cat_ord", "pos", "canonical_id", "token", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def fuzzy_best(concepts: DataFrame, catalog: DataFrame, rules: Rules = Rules(), least: float = 0.0) -> DataFrame:
    """concept, fuzzy_id, similarity: the most similar form, first in the catalog among equals, if it is at least `least` similar.

    Vectors have unit length, so a form that has none of a concept's rarest words cannot reach `least` where the rest of the
    concept's vector is shorter than that.  Only those rare words are joined with the catalog to find candidates, and a word
    that most concepts and forms share pairs nothing by itself.
    """
    vectors = form_vectors(surface_forms(catalog), rules.stemmed)
    words = concepts.select("concept", F.explode(tx.concept_tokens(F.col("concept"), rules.stemmed)).alias("token"))
    known = words.groupBy("concept", "token").agg(F.count("*").alias("tf")).join(vectors.select("token", "idf").distinct(), "token")
    known = known.withColumn("w", F.col("tf") * F.col("idf"))
    norm = known.groupBy("concept").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rest = Window.partitionBy("concept").orderBy(F.desc("idf"), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("concept")
    mass = F.col("w") * F.col("w")
    rare = known.withColumns({"__rest": F.sum(mass).over(rest), "__all": F.sum(mass).over(whole)}).filter(F.col("__rest") >= F.col("__all") * (least * least - 1e-9))
    pairs = rare.select("concept", "token").join(vectors.select("token", "cat_ord", "pos"), "token").select("concept", "cat_ord", "pos").distinct()
    scores = pairs.join(known, "concept").join(vectors.drop("idf"), ["cat_ord", "pos", "token"]).groupBy("concept", "cat_ord", "pos", "canonical_id").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = scores.join(norm, "concept").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 12)).filter(F.col("similarity") >= least)
    best = F.max_by(F.struct("canonical_id", "similarity"), F.struct("similarity", -F.col("cat_ord"), -F.col("pos"))).alias("best")
    return scored.groupBy("concept").agg(best).select("concept", F.col("best.canonical_id").alias("fuzzy_id"), F.col("best.similarity").alias("similarity"))


def match_concepts(concepts: DataFrame, catalog: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """concept (each once) -> concept, canonical_id, match_type, base_confidence."""
    forms = surface_forms(catalog)
    order = F.struct("cat_ord", "pos")
    table = lambda keep, key, name: forms.filter(keep).groupBy(key.alias(f"__{name}")).agg(F.max_by("canonical_id", order).alias(f"__{name}_id"))
    label = table("pos = 0", tx.tight(F.col("form")), "label")
    synonym = table("pos > 0", tx.tight(F.col("form")), "synonym")
    loose = table("true", tx.loose(F.col("form")), "loose")
    x = concepts.select("concept").withColumns({"__tight": tx.tight(F.col("concept")), "__free": tx.loose(F.col("concept"))})
    x = x.join(label, F.col("__tight") == F.col("__label"), "left").join(synonym, F.col("__tight") == F.col("__synonym"), "left").join(loose, F.col("__free") == F.col("__loose"), "left")
    some = F.coalesce("concept", F.lit("")) != ""
    tier = F.when(~some, F.lit(None).cast("string")).when(F.col("__label_id").isNotNull(), "exact_label").when(F.col("__synonym_id").isNotNull(), "synonym").when(F.col("__loose_id").isNotNull(), "normalized")
    x = x.select("concept", tier.alias("tier"), F.coalesce("__label_id", "__synonym_id", "__loose_id").alias("tier_id"))
    if rules.fuzzy:
        left = x.filter("tier IS NULL AND concept <> ''").select("concept")
        x = x.join(fuzzy_best(left, catalog, rules, rules.min_similarity).withColumnRenamed("concept", "__c"), F.col("concept") == F.col("__c"), "left").drop("__c")
    else:
        x = x.withColumns({"fuzzy_id": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    near = F.col("tier").isNull() & (F.col("similarity") >= rules.min_similarity)
    kind = F.when(F.col("tier").isNotNull(), F.col("tier")).when(near, "fuzzy").otherwise("unmapped")
    sure = F.when(F.col("tier") == "exact_label", rules.exact_label).when(F.col("tier") == "synonym", rules.synonym).when(F.col("tier") == "normalized", rules.normalized).when(near, F.round(F.least("similarity", F.lit(rules.max_confidence)), 3)).otherwise(0.0)
    return x.select("concept", F.when(F.col("tier").isNotNull(), F.col("tier_id")).when(near, F.col("fuzzy_id")).alias("canonical_id"), kind.alias("match_type"), sure.alias("base_confidence"))


def ontology_objects(clauses: DataFrame, catalog: DataFrame, domains: DataFrame, rules: Rules = Rules(), suggestions: DataFrame | None = None) -> DataFrame:
    """One row per clause with a concept: its mapping, confidence after the domain check, and whether it needs review.

    suggestions (concept, canonical_id, confidence) fill the suggested columns of unmapped rows and change nothing else.
    """
    s = "semantic"
    rows = clauses.filter(F.coalesce(f"{s}.concept", F.lit("")) != "").select("stem", "ord", "clause_id", "clause_no", F.col(f"{s}.concept").alias("source_concept"), F.col(f"{s}.domain").alias("__token"), f"{s}.action", f"{s}.obligation_type", f"{s}.mandatory_flag")
    matched = match_concepts(rows.select(F.col("source_concept").alias("concept")).distinct(), catalog, rules)
    known = catalog.select(F.col("canonical_id").alias("__id"), F.col("label").alias("canonical_label"), F.col("domain").alias("__domain"), F.col("status").alias("__status"))
    labels = domains.select(F.col("token").alias("__t"), F.col("label").alias("domain"))
    x = rows.join(matched, F.col("source_concept") == F.col("concept"), "left").join(known, F.col("canonical_id") == F.col("__id"), "left").join(labels, F.col("__token") == F.col("__t"), "left")
    differs = F.col("canonical_id").isNotNull() & F.coalesce((tx.present("domain") != tx.present("__domain")), F.lit(False))
    sure = F.when(differs & F.lit(rules.penalize_mismatch), F.greatest(F.lit(0.0), F.col("base_confidence") - rules.mismatch_penalty)).otherwise(F.col("base_confidence"))
    review = F.col("canonical_id").isNull() | (F.coalesce(F.col("__status") == "draft", F.lit(False)) & F.lit(rules.draft_needs_review)) | (sure < rules.auto_accept) | differs
    x = x.withColumns({"match_confidence": F.round(sure, 3), "review_required": review})
    if suggestions is None:
        x = x.withColumns({"suggested_canonical_id": F.lit(None).cast("string"), "suggested_label": F.lit(None).cast("string"), "suggestion_confidence": F.lit(None).cast("double")})
    else:
        x = x.join(accepted_suggestions(suggestions, catalog, rules), (F.col("source_concept") == F.col("__for")) & F.col("canonical_id").isNull(), "left").drop("__for")
    return x.select("stem", "ord", "clause_id", "clause_no", "source_concept", "canonical_id", "canonical_label", "domain", "action", "obligation_type", "mandatory_flag", "match_type", "match_confidence", "review_required", "suggested_canonical_id", "suggested_label", "suggestion_confidence")


def unmapped_concepts(objects: DataFrame) -> DataFrame:
    """Different concepts without an entry, in order."""
    return objects.filter("canonical_id IS NULL").select(F.col("source_concept").alias("concept")).distinct().orderBy("concept")


def accepted_suggestions(suggestions: DataFrame, catalog: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Replies that name a real entry with enough confidence; the last one for a concept counts (by reply_ord if given)."""
    number = suggestions["confidence"].try_cast("double")
    turn = F.col("reply_ord") if "reply_ord" in suggestions.columns else F.lit(0)
    real = catalog.select(F.col("canonical_id").alias("__id"), F.col("label").alias("__label"))
    x = suggestions.filter(number >= rules.suggestion_floor).join(real, F.col("canonical_id") == F.col("__id"))
    best = x.groupBy(F.col("concept").alias("__for")).agg(F.max_by(F.struct("canonical_id", "__label", v.confidence(F.col("confidence"), 3).alias("c")), turn).alias("b"))
    return best.select("__for", F.col("b.canonical_id").alias("suggested_canonical_id"), F.col("b.__label").alias("suggested_label"), F.col("b.c").alias("suggestion_confidence"))


def suggest(objects: DataFrame, catalog: DataFrame, hook: Callable[[list[str], list[tuple[str, str]]], list[dict]], rules: Rules = Rules()) -> DataFrame:
    """Ask a hook about unmapped concepts, a batch at a time on the executors -> concept, canonical_id, confidence, reply_ord.

    hook(concepts, [(id, label)]) returns dicts; a batch whose hook fails gives no rows.  The catalog is a small table
    that goes to the hook whole, so it is collected (at most 100,000 entries).
    """
    entries = [(r["canonical_id"], r["label"]) for r in catalog.select("canonical_id", "label").limit(100_001).collect()]
    if len(entries) > 100_000:
        raise ValueError("the catalog is too large for a hook")
    size = rules.suggestion_batch

    def run(batches):
        import pandas as pd

        for pdf in batches:
            words = pdf["concept"].tolist()
            for at in range(0, len(words), size):
                try:
                    replies = hook(words[at : at + size], entries)
                except Exception:  # noqa: BLE001  a failed batch is skipped, as its concepts stay unmapped
                    continue
                yield pd.DataFrame([(x.get("concept"), x.get("canonical_id"), None if x.get("confidence") is None else str(x["confidence"]), k) for k, x in enumerate(replies)], columns=["concept", "canonical_id", "confidence", "reply_ord"])

    left = objects.filter("canonical_id IS NULL").select(F.col("source_concept").alias("concept")).distinct()
    return left.mapInPandas(run, "concept string, canonical_id string, confidence string, reply_ord int")


def coverage(objects: DataFrame, by: str | None = "stem") -> DataFrame:
    """total, mapped, unmapped, coverage_pct (one place; 0 when empty), review_required, suggested."""
    total, mapped = F.count("*"), F.count("canonical_id")
    rows = objects.groupBy(by) if by else objects.groupBy()
    return rows.agg(total.alias("total"), mapped.alias("mapped"), (total - mapped).alias("unmapped"), F.when(total > 0, F.round(100.0 * mapped / total, 1)).otherwise(0.0).alias("coverage_pct"), F.count_if("review_required").alias("review_required"), F.count("suggested_canonical_id").alias("suggested"))
