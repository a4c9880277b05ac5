"""Stored indexes that answer top-k questions without reading or adding up all of a word's postings.

An index of a corpus is two tables.  `weights` holds unit tf-idf weights (stem, ord, term, weight) in order of term and falling
weight, so each page of its files is a stretch of one term's impacts, whose bounds the file itself holds.  `lexicon` holds for each term its
document frequency, its idf, its largest weight and how many weights lie in each eighth of an octave.

A question's score of a clause is a sum over its terms, and both sides have unit length.  So a clause with weight w for a term of
query weight q scores at most q w + sqrt(1 - q^2) sqrt(1 - w^2), and at most q w + the other terms' largest shares.  Once the k-th
best score is known to be `floor` or more, weights with a bound below it can be skipped whole: no clause that has one is among
the best k.  Terms that together can't reach the floor bring no clause in; their weights are read only for clauses of the others.

The floor comes from the largest weights of each term, which are read first.  All bounds are exact; results are those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions import values as v
from clausemill.operators.index import clause_terms, corpus_idf, document_idf, frequency_changes, idf_of_changes, is_term, postings, query_weights, unit_weights
from clausemill.tables import settle

_EIGHTHS = 8
#: Scores are rounded to four places before they are compared.
_ROUNDED = 1e-4


@dataclass(frozen=True)
class Index:
    """lexicon: term, df, idf, top, levels (level, n).  weights: stem, ord, term, weight."""

    lexicon: DataFrame
    weights: DataFrame


def _level(weight: Column) -> Column:
    """Eighths of an octave below 1."""
    return F.floor(-F.log2(weight) * _EIGHTHS).cast("int")


def impact_ordered(weights: DataFrame) -> DataFrame:
    """By term and falling weight, dealt out by ranges of both, so a term that every clause has is spread over tasks and files."""
    order = [F.asc("term"), F.desc("weight"), F.asc("stem"), F.asc("ord")]
    return weights.select("stem", "ord", "term", "weight").repartitionByRange(*order).sortWithinPartitions(*order)


def lexicon(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """Counts by level are added up in each task first, so a frequent term is a few rows for each; these meet the idf in one deal by ranges of terms."""
    counted = weights.groupBy("term", _level(F.col("weight")).alias("level")).agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    both = counted.unionByName(idf.select("term", "df", "idf"), allowMissingColumns=True).repartitionByRange("term")
    levels = F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n")))).alias("levels")
    met = both.groupBy("term").agg(F.max("df").alias("df"), F.max("idf").alias("idf"), F.max("top").alias("top"), levels)
    return met.filter("df IS NOT NULL AND top IS NOT NULL").sortWithinPartitions("term")


def build(post: DataFrame, rows: DataFrame) -> Index:
    """The index of a corpus, as tables in the shared folder."""
    idf = settle(corpus_idf(post, rows), "idf")
    return _stored(unit_weights(post, idf), idf)


def _stored(unit: DataFrame, idf: DataFrame) -> Index:
    weights = settle(impact_ordered(unit), "impacts", even=False)
    return Index(settle(lexicon(weights, idf), "lexicon", even=False), weights)


#: Terms that are broadcast with their idf, about 100 bytes each, the most frequent ones; the others are looked up by shuffle.
MOST_TERMS = 1_000_000


def text_weights(rows: DataFrame, text: Column, idf: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """unit_weights() of clauses (stem, ord) from their texts, dealt out by clause.  idf: term, df, idf, or stem, term, df, idf.

    Texts are dealt out by clause once, and words are counted, weighed and brought to unit length where they lie.  The most frequent terms,
    whole octaves of df up to `most` terms, are broadcast.  Terms of a single clause, most of a vocabulary, share one idf under a corpus-wide idf.
    Only clauses' other terms, a few hundredths of all postings, meet their idf by shuffle and come to the texts as rows beside them.
    """
    keys = ["stem", "term"] if "stem" in idf.columns else ["term"]
    one = None if "stem" in idf.columns else idf.filter("df = 1").select("idf").first()
    known, octave, lowest, have = idf if one is None else idf.filter("df > 1"), F.floor(F.log2("df")), 64, 0
    counts = {r["o"]: r["n"] for r in known.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()}  # a row for each octave
    for o in sorted(counts, reverse=True):
        if have + counts[o] > most:
            break
        have, lowest = have + counts[o], o
    frequent = F.broadcast(known.filter(octave >= lowest).select(*keys, F.col("idf").alias("near")))
    if have == sum(counts.values()):
        post = postings(rows.select("stem", "ord", text.alias("text")).repartition("stem", "ord"), F.col("text")).withColumn("far", F.lit(None).cast("double"))
    else:
        others = clause_terms(rows, text, "stem", "ord").join(frequent.drop("near"), keys, "left_anti")
        beside = others.join(known.filter(octave < lowest).select(*keys, F.col("idf").alias("far")), keys).select("stem", "ord", "term", "far")
        both = rows.select("stem", "ord", text.alias("text")).unionByName(beside, allowMissingColumns=True).repartition("stem", "ord")
        word = lambda term, n, far: F.struct(term.alias("term"), F.lit(n).cast("long").alias("n"), far.cast("double").alias("far"))
        words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), lambda t: word(t, 1, F.lit(None)))
        found = both.select("stem", "ord", F.explode(F.when(F.col("term").isNull(), words).otherwise(F.array(word(F.col("term"), 0, F.col("far"))))).alias("x")).select("stem", "ord", "x.*")
        post = found.filter(is_term()).groupBy("stem", "ord", "term").agg(F.sum("n").alias("tf"), F.max("far").alias("far"))
    x = post.join(frequent, keys, "left").withColumn("idf", F.coalesce("near", "far", F.lit(one["idf"] if one else None))).filter("idf IS NOT NULL")
    x = x.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("stem", "ord")))
    return x.select("stem", "ord", "term", v.unit(F.col("w"), norm).alias("weight"))


def text_idf(rows: DataFrame, text: Column) -> DataFrame:
    """corpus_idf() without postings, as a table."""
    return settle(idf_of_changes(frequency_changes(clause_terms(rows, text), rows)), "idf", even=False)


def text_document_idf(rows: DataFrame, text: Column) -> DataFrame:
    """document_idf() without postings."""
    return document_idf(clause_terms(rows, text, "stem").withColumn("tf", F.lit(1)), rows)


def text_scores(rows: DataFrame, text: Column, idf: DataFrame, query: str, most: int = MOST_TERMS) -> DataFrame:
    """index.sparse_scores() from texts: clauses are weighed where they lie, and only the question's words go on."""
    wanted = query_weights(idf, query)
    asked = F.array_distinct(tx.tokens(F.lit(query)))
    weights = text_weights(rows, text, idf, most).filter(F.array_contains(asked, F.col("term")))
    found = weights.join(wanted, ["stem", "term"]) if "stem" in idf.columns else weights.join(F.broadcast(wanted), "term")
    return found.groupBy("stem", "ord").agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).filter("score > 0")


def build_from_text(rows: DataFrame, text: Column, most: int = MOST_TERMS) -> Index:
    """build() without a table of postings.  rows: one for each clause (stem, ord)."""
    idf = text_idf(rows, text)
    return _stored(text_weights(rows, text, idf, most), idf)


@dataclass(frozen=True)
class _Term:
    """A term of a question: its weight there, its largest weight in the index, and how many weights lie in each level."""

    word: str
    q: float
    top: float
    levels: list[tuple[int, int]]

    @property
    def most(self) -> float:
        return self.q * self.top

    def above(self, cut: float) -> int:
        """How many weights lie in levels that reach `cut`."""
        return sum(n for level, n in self.levels if 2 ** (-level / _EIGHTHS) >= cut)

    def head(self, n: int) -> float:
        """A cut above which about n weights lie, one level at least."""
        have = 0
        for level, count in self.levels:
            have += count
            if have >= n:
                return 2 ** (-(level + 1) / _EIGHTHS)
        return 0.0

    def cut(self, floor: float, others: float) -> float:
        """The least weight with which a clause can reach the floor."""
        away = math.sqrt(max(0.0, 1 - self.q**2))

        def bound(w: float) -> float:
            return self.q * w + min(others, away * math.sqrt(max(0.0, 1 - w * w)))

        low, high = 0.0, self.q  # the bound rises up to w = q
        if bound(low) >= floor:
            return 0.0
        if bound(high) < floor:
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if bound(mid) >= floor else (mid, high)
        return low


def question_terms(index: Index, query: str) -> list[_Term]:
    """The question's words that the index knows, at unit length: as many rows as it has different words."""
    spark = index.lexicon.sparkSession
    asked = {r["t"]: r["n"] for r in spark.range(1).select(F.explode(tx.tokens(F.lit(query))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    found = index.lexicon.filter(F.col("term").isin(sorted(asked))).collect()
    norm = math.sqrt(math.fsum((asked[r["term"]] * r["idf"]) ** 2 for r in found))
    return [_Term(r["term"], asked[r["term"]] * r["idf"] / norm, r["top"], [(x["level"], x["n"]) for x in r["levels"]]) for r in sorted(found, key=lambda r: r["term"])]


def _rows(index: Index, cuts: list[tuple[_Term, float]], within: Column | None = None) -> DataFrame:
    """stem, ord, part: the weights above each term's cut, times the question's.  Term and cut are literals, which the scan pushes down."""
    wanted, q = F.lit(False), None
    for t, cut in cuts:
        wanted = wanted | ((F.col("term") == t.word) & (F.col("weight") >= cut))
        q = F.when(F.col("term") == t.word, t.q) if q is None else q.when(F.col("term") == t.word, t.q)
    rows = index.weights.filter(wanted if within is None else wanted & within)
    return rows.select("stem", "ord", (F.col("weight") * (F.lit(0.0) if q is None else q)).alias("part"))


@dataclass(frozen=True)
class Plan:
    """What a question reads: cuts by term, the terms that bring clauses in, the floor, and how many weights that is out of how many."""

    terms: list[_Term]
    cuts: dict[str, float]
    leading: set[str]
    floor: float
    read: int
    of: int


def plan(index: Index, query: str, k: int, head: int = 4096, within: Column | None = None) -> Plan:
    """Read about `head` of the largest weights of each term for a floor, and cut the terms by it."""
    terms = question_terms(index, query)
    floor, heads = 0.0, [(t, t.head(head)) for t in terms]
    if terms and any(cut > 0 for _, cut in heads):
        best = _rows(index, heads, within).groupBy("stem", "ord").agg(F.sum("part").alias("score")).orderBy(F.desc("score")).limit(k).collect()
        floor = max(0.0, best[-1]["score"] - 2 * _ROUNDED) if len(best) == k else 0.0
    total = sum(t.most for t in terms)
    cuts = {t.word: t.cut(floor, total - t.most) for t in terms}
    leading, left = {t.word for t in terms}, 0.0
    for t in sorted(terms, key=lambda t: t.most):
        left += t.most
        if left >= floor:
            break
        leading.discard(t.word)
    return Plan(terms, cuts, leading, floor, sum(t.above(cuts[t.word]) for t in terms), sum(n for t in terms for _, n in t.levels))


def top_scores(index: Index, query: str, k: int, head: int = 4096, most: int = 1_000_000, within: Column | None = None) -> DataFrame:
    """stem, ord, score: all clauses that may be among the best k, with their exact scores, and perhaps others with less than theirs.

    within: a condition on stem and ord that clauses must fulfil.
    """
    p = plan(index, query, k, head, within)
    pick = lambda lead: _rows(index, [(t, p.cuts[t.word]) for t in p.terms if (t.word in p.leading) == lead], within)
    rows = pick(True)
    if len(p.leading) < len(p.terms):
        rest = pick(False)
        if sum(t.above(p.cuts[t.word]) for t in p.terms if t.word in p.leading) <= most:
            rest = rest.join(F.broadcast(rows.select("stem", "ord").distinct()), ["stem", "ord"], "left_semi")
        rows = rows.union(rest)
    return rows.groupBy("stem", "ord").agg(F.sum("part").alias("score")).filter("score > 0")


@dataclass(frozen=True)
class DocumentIndex:
    """Indexes of single documents side by side.  idf: stem, term, idf.  weights: stem, ord, term, weight, unit length under the document's idf."""

    idf: DataFrame
    weights: DataFrame


def build_by_document(post: DataFrame, rows: DataFrame) -> DocumentIndex:
    return _stored_by_document(lambda idf: unit_weights(post, idf), document_idf(post, rows))


def build_by_document_from_text(rows: DataFrame, text: Column, most: int = MOST_TERMS) -> DocumentIndex:
    """build_by_document() without a table of postings.  rows: one for each clause (stem, ord)."""
    return _stored_by_document(lambda idf: text_weights(rows, text, idf, most), text_document_idf(rows, text))


def _stored_by_document(weigh: Callable[[DataFrame], DataFrame], idf: DataFrame) -> DocumentIndex:
    idf = settle(idf.repartitionByRange("term", "stem").sortWithinPartitions("term", "stem"), "idf_by_document", even=False)
    return DocumentIndex(idf, settle(impact_ordered(weigh(idf)), "impacts_by_document", even=False))


def search_documents(index: DocumentIndex, query: str, k: int = 5) -> DataFrame:
    """stem, ord, score, rank: the best k clauses of each document under its own weights, by exact score, then order; scores to four places.

    Both scans read the question's words only; lengths are stored with the weights.
    """
    spark = index.idf.sparkSession
    asked = {r["t"]: r["n"] for r in spark.range(1).select(F.explode(tx.tokens(F.lit(query))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    known = index.idf.filter(F.col("term").isin(sorted(asked)))
    times = None
    for word, n in sorted(asked.items()):
        times = F.when(F.col("term") == word, n) if times is None else times.when(F.col("term") == word, n)
    x = known.withColumn("w", (F.lit(0) if times is None else times) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("stem")))  # over the words of one question
    wanted = x.select(F.col("stem").alias("of"), F.col("term").alias("word"), v.unit(F.col("w"), norm).alias("q"))
    rows = index.weights.filter(F.col("term").isin(sorted(asked)))
    scored = rows.join(wanted, (F.col("stem") == F.col("of")) & (F.col("term") == F.col("word"))).groupBy("stem", "ord").agg(F.sum(F.col("weight") * F.col("q")).alias("score")).filter("score > 0")
    turn = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc(F.round("score", 10)), "ord"))
    return scored.withColumn("rank", turn).filter(F.col("rank") <= k).withColumn("score", F.round("score", 4))
