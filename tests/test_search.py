"""Stored indexes against full scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausemill.operators import index as ix
from clausemill.operators import search as se
from clausemill.tables import kept, release, settle


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choice(words[: rnd.randint(1, 40)]) for _ in range(rnd.randint(0, 12))) for _ in range(700)]
    texts += ["common common common rare", "common rare rare rare", "rare", "common " * 30, None, ""]
    rows = spark.createDataFrame([(f"d{k % 5}", k, f"common {t}" if t and k % 3 else t) for k, t in enumerate(texts)], "stem string, ord long, text string")
    post = settle(ix.postings(rows, F.col("text")), "post")
    return rows, post, se.build(post, rows)


@pytest.mark.parametrize("query", ["rare", "w0 w1 w2 w3 w39", "common", "", "rare rare rare common w39"])
@pytest.mark.parametrize("head", [1, 4096])
def test_bounded_search_is_a_full_scan(corpus, query, head):
    rows, post, index = corpus
    for k in (1, 6):
        want = ix.top_hits(ix.sparse_scores(post, ix.corpus_idf(post, rows), query), None, k).collect()
        assert ix.top_hits(se.top_scores(index, query, k, head=head), None, k).collect() == want
    one = F.col("stem") == "d1"
    inside = ix.sparse_scores(post, ix.corpus_idf(post, rows), query).filter(one)
    assert ix.top_hits(se.top_scores(index, query, 3, head=head, within=one), None, 3).collect() == ix.top_hits(inside, None, 3).collect()


def test_bounds_skip_weights_and_reach_the_scan(corpus):
    _, _, index = corpus
    p = se.plan(index, "rare common", 1, head=1)
    assert p.floor > 0.5 and p.leading == {"rare"} and p.cuts["rare"] > 0.8
    text = se.top_scores(index, "rare common", 1, head=1)._jdf.queryExecution().toString()
    pushed = next(x for x in text.splitlines() if "PushedFilters" in x)
    assert "EqualTo(term,rare)" in pushed and "GreaterThanOrEqual(weight," in pushed


def test_documents_by_their_own_weights(corpus):
    rows, post, _ = corpus
    index = se.build_by_document(post, rows)
    for query in ("rare common w1", "nothing", ""):
        key = lambda r: (r["stem"], r["rank"])
        assert sorted(se.search_documents(index, query, 4).collect(), key=key) == sorted(ix.search(post, rows, query, 4).select("stem", "ord", "score", "rank").collect(), key=key)


@pytest.mark.parametrize("most", [0, 1000])
def test_an_index_from_texts_is_that_of_postings(corpus, most):
    rows, post, index = corpus
    made = se.build_from_text(rows, F.col("text"), most)
    near = lambda df: sorted((r["stem"], r["ord"], r["term"], round(r["weight"], 10)) for r in df.collect())
    assert near(made.weights) == near(index.weights)
    known = lambda x: sorted((r["term"], r["df"], round(r["idf"], 10), round(r["top"], 10), r["levels"]) for r in x.lexicon.collect())
    assert known(made) == known(index)
    by, want = se.build_by_document_from_text(rows, F.col("text"), most), se.build_by_document(post, rows)
    assert near(by.weights) == near(want.weights)
    assert sorted(map(tuple, by.idf.collect())) == sorted(map(tuple, want.idf.collect()))


def test_texts_are_weighed_without_a_shuffle_of_postings(corpus):
    rows, post, _ = corpus
    idf = settle(ix.corpus_idf(post, rows), "idf")
    plan = se.text_weights(rows, F.col("text"), idf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_revision_cancels_within_its_row(spark):
    rows = spark.createDataFrame([("one two two", "two three"), ("four", None), (None, "five the"), ("one", "one")], "old string, new string")
    got = {r["term"]: (r["d_df"], r["d_rows"]) for r in ix.revision_changes(rows, F.col("old"), F.col("new")).collect()}
    assert got == {"one": (-1, 0), "three": (1, 0), "four": (-1, 0), "five": (1, 0)}


def test_kept_tables_follow_their_files(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def table():
        made.append(1)
        return (settle(spark.read.parquet(path), "copy"),)

    for n in (3, 3, 5):
        if len(made) == 0 or n == 5:
            spark.range(n).write.mode("overwrite").parquet(path)
        assert kept(spark, "copy", [path], table)[0].count() == n
    assert len(made) == 2
    release(spark)
    assert kept(spark, "copy", [path], table)[0].count() == 5 and len(made) == 3


@pytest.mark.parametrize("most", [0, 3, 8, 1000])
def test_terms_beyond_the_bound_alone_are_looked_up_by_shuffle(spark, most):
    texts = ["aa bb cc dd aa", "aa bb cc ee", "aa bb ff ff", "aa gg cc", None, "", "aa hh bb"]
    rows = spark.createDataFrame([(f"s{k % 2}", k, t) for k, t in enumerate(texts)], "stem string, ord long, text string")
    post = ix.postings(rows, F.col("text"))
    got = lambda df: {(r["stem"], r["ord"], r["term"]): r["weight"] for r in df.collect()}
    for idf in (ix.corpus_idf(post, rows), ix.document_idf(post, rows)):
        made = se.text_weights(rows, F.col("text"), idf, most)
        assert got(made) == pytest.approx(got(ix.unit_weights(post, idf)))
        assert "Broadcast" in made._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in made._jdf.queryExecution().optimizedPlan().toString()
    scored = lambda df: {(r["stem"], r["ord"]): r["score"] for r in df.collect()}
    assert scored(se.text_scores(rows, F.col("text"), ix.corpus_idf(post, rows), "aa ff zz", most)) == pytest.approx(scored(ix.sparse_scores(post, ix.corpus_idf(post, rows), "aa ff zz")))
