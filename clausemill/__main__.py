"""Command line: run a corpus, search it, answer from it, and story digests.

python -m clausemill run --pages IN --config ROOT --out OUT [--pack CODE] [--no-denoise] [--regulator R] [--country C] [--source-type T]
python -m clausemill update --pages IN --config ROOT --out OUT [as run] [--keep-others] [--index] [--compact]
python -m clausemill search --out OUT --query TEXT [--top-k 5] [--stem S]
python -m clausemill answer --out OUT --query TEXT [--top-k 6] [--stem S]
python -m clausemill summary --out OUT
python -m clausemill stories --topics FILE --payloads TABLE --out OUT

`run` makes all tables of a corpus anew; `update` keeps tables that follow it, reads the documents that changed, and drops those that are not
among the pages unless --keep-others.  `search`, `answer` and `summary` take either's folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill import plans
from clausemill.operators import answer as an
from clausemill.operators import catalog, extract, index, news
from clausemill.operators import search as se
from clausemill.plans.runs import Runs
from clausemill.sources import readers, writers


def _metadata(pages: DataFrame, args: argparse.Namespace) -> DataFrame:
    given = {"regulator": args.regulator, "regulator_country": args.country, "source_type": args.source_type}
    x = extract.metadata(pages, overrides={k: v for k, v in given.items() if v})
    return x.select("stem", "document_id", "regulator", "regulator_country", "title", "source_type", "version", F.lit(args.pack).cast("string").alias("jurisdiction"), F.lit("").alias("catalog_version"))


def _follows(spark: SparkSession, path: str) -> Runs | None:
    """The folder as one of `update`, if it is."""
    runs = Runs(spark, path)
    return runs if runs.head else None


def _hits(found: DataFrame, clauses: DataFrame, k: int) -> DataFrame:
    return index.top_hits(found, None, k).join(clauses.select("stem", "ord", "clause_id", "clause_no", "title"), ["stem", "ord"]).select(F.col("stem").alias("document_id"), "clause_id", "clause_no", "title", "score")


def _found(spark: SparkSession, args: argparse.Namespace) -> tuple:
    """Scores of the question, and the tables that an answer needs."""
    runs = _follows(spark, args.out)
    corpus = None if runs else plans.load(spark, args.out)
    clauses, post = (runs.table("clauses"), runs.table("postings")) if runs else (corpus.clauses, corpus.postings)
    if args.stem is not None:  # one document is searched under its own weights
        own = post.filter(F.col("stem") == args.stem)
        scores = index.sparse_scores(own, index.corpus_idf(own, clauses.filter(F.col("stem") == args.stem)), args.query)
    else:
        scores = runs.top_scores(args.query, args.top_k) if runs else se.top_scores(corpus.index(), args.query, args.top_k)
    return scores, clauses, runs.adjacency() if runs else corpus.adjacency()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="clausemill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    of = {name: sub.add_parser(name) for name in ("run", "update", "search", "answer", "summary", "stories")}
    for parser in of.values():
        parser.add_argument("--out", required=True)
    for command in ("run", "update"):
        for name in ("--pages", "--config"):
            of[command].add_argument(name, required=True)
        for name in ("--pack", "--regulator", "--country", "--source-type"):
            of[command].add_argument(name)
        of[command].add_argument("--no-denoise", action="store_true")
    for name in ("--keep-others", "--index", "--compact"):
        of["update"].add_argument(name, action="store_true")
    for name, k in (("search", 5), ("answer", 6)):
        of[name].add_argument("--query", required=True)
        of[name].add_argument("--top-k", type=int, default=k)
        of[name].add_argument("--stem")
    for name in ("--topics", "--payloads"):
        of["stories"].add_argument(name, required=True)
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("clausemill").getOrCreate()
    if args.command in ("run", "update"):
        pages = readers.read_pages(spark, args.pages)
        layers = catalog.load_catalog(spark, args.config, args.pack)
        given = pages, layers["concepts"], layers["domains"], _metadata(pages, args)
        if args.command == "run":
            plans.run(args.out, *given, denoise=not args.no_denoise)
        else:
            runs = Runs(spark, args.out)
            done = runs.update(*given, whole=not args.keep_others, denoise=not args.no_denoise)
            if args.compact and runs.head:
                runs.compact()
            if args.index and runs.head:
                runs.build_index()
            print(f"{done.read} read, {done.gone} gone, state {runs.head}")
    elif args.command == "stories":
        stories = news.payload_rows(spark.read.parquet(args.payloads))
        writers.write_text(news.digest(stories, readers.read_topics(spark, args.topics)), args.out, "topic")
    elif args.command == "summary":
        runs = _follows(spark, args.out)
        plans.summaries(runs or plans.load(spark, args.out)).orderBy("stem", "step", "what").show(1000, truncate=False)
    elif args.command == "search":
        runs = _follows(spark, args.out)
        if runs:
            clauses = runs.table("clauses")
            found = index.search(runs.table("postings"), clauses, args.query, args.top_k)
        else:
            corpus = plans.load(spark, args.out)
            clauses, found = corpus.clauses, se.search_documents(corpus.document_index(), args.query, args.top_k)
        rows = found if args.stem is None else found.filter(F.col("stem") == args.stem)
        rows.join(clauses.select("stem", "ord", "clause_no", "title"), ["stem", "ord"]).orderBy("stem", "rank").show(1000, truncate=110)
    else:
        scores, clauses, near = _found(spark, args)
        documents = clauses.select(F.col("stem").alias("document_id"), "stem").distinct()
        got = an.answer(args.query, _hits(scores, clauses, args.top_k), clauses, near, near, documents)
        an.evidence_view(got.evidence).show(args.top_k, truncate=110)
        got.impact.show(8, truncate=110)
        got.path.select(F.explode("path").alias("step")).show(truncate=False)
        got.confidence.show(truncate=False)


if __name__ == "__main__":
    main()
