"""Runs that follow a corpus against runs over all of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from test_engine import catalog, domains  # noqa: F401

from clausemill import plans, schemas
from clausemill.operators import adjacency as ad
from clausemill.operators import answer as an
from clausemill.operators import index as ix
from clausemill.plans.runs import Change, Runs, content_hash


def _pages(spark, docs):
    return spark.createDataFrame([(s, p, t) for s, texts in docs.items() for p, t in enumerate(texts, 1)], schemas.PAGES)


def _meta(spark, stems, title="Doc"):
    return spark.createDataFrame([(s, None, "CB", "XX", f"{title} {s}", "law", None, None, "g=1") for s in stems], "stem string, document_id string, regulator string, regulator_country string, title string, source_type string, version string, jurisdiction string, catalog_version string")


def _text(s, more=""):
    return f"1. Title {s}\nAll banks keep collateral records {more}.\n2. Other\nmore text about lending {s}"


def _rows(df):
    return sorted(repr({k: x[k] for k in sorted(x)}) for x in (r.asDict(True) for r in df.collect()))


@pytest.fixture
def taxonomy(catalog, domains):
    return catalog, domains


def test_runs_read_what_changed_and_equal_a_whole_run(spark, taxonomy, tmp_path):
    catalog, domains = taxonomy
    names = lambda units: [{"index": u["index"], "domain": "Prudential", "concept": "Collateral Monitoring", "obligation_type": "Reporting", "confidence_score": "0.7"} for u in units]
    runs, go = Runs(spark, str(tmp_path / "live")), {"classifier": names}
    docs = {s: [_text(s), _text(s, "again")] for s in ("a", "b", "c")}
    assert runs.update(_pages(spark, docs), catalog, domains, _meta(spark, docs), **go) == Change(1, 3, 0)
    assert runs.update(_pages(spark, docs).repartition(3), catalog, domains, _meta(spark, docs), **go).run is None
    docs = {"a": [_text("a"), _text("a", "changed words")], "b": docs["b"], "d": [_text("d")]}
    assert runs.update(_pages(spark, docs), catalog, domains, _meta(spark, docs), **go) == Change(2, 2, 1)
    assert {r.stem for r in spark.read.parquet(f"{tmp_path}/live/lines/run=2").select("stem").distinct().collect()} == {"a", "d"}
    whole = plans.run(str(tmp_path / "whole"), _pages(spark, docs), catalog, domains, _meta(spark, docs), **go)

    def same():
        for name in ("lines", "nodes", "clauses", "objects", "graph_nodes", "graph_edges", "postings"):
            assert _rows(runs.table(name)) == _rows(getattr(whole, name)), name
        assert _rows(runs.idf().withColumn("idf", F.round("idf", 9))) == _rows(whole.idf.withColumn("idf", F.round("idf", 9)))
        x = runs.adjacency()
        assert _rows(x.by_source.drop("bucket")) == _rows(whole.graph_edges) == _rows(x.by_target.drop("bucket"))
        hits = ix.retrieve(runs.table("postings"), runs.table("clauses"), "collateral records changed", k=3).join(runs.table("clauses"), ["stem", "ord"]).select(F.col("stem").alias("document_id"), "clause_id", "clause_no", "title", "score")
        assert _rows(an.enrich(hits, x, x)) == _rows(an.enrich(hits, whole.graph_nodes, whole.graph_edges))

    old = Runs(spark, str(tmp_path / "live"))
    runs.compact()
    assert old.head == 2 and old.table("postings").count() == whole.postings.count()  # readers of the earlier state still read it
    runs.vacuum()
    same()
    assert not (tmp_path / "live/lines/run=1").exists()
    assert runs.update(_pages(spark, {"b": [_text("b", "new")]}), catalog, domains, _meta(spark, ["b"]), whole=False, version="2", **go).read == 1
    assert {r.stem for r in runs.documents().collect()} == {"a", "b", "d"}


def test_a_failed_run_is_seen_by_nobody_and_one_writer_wins(spark, taxonomy, tmp_path):
    catalog, domains = taxonomy
    path, docs = str(tmp_path), {"a": [_text("a")]}
    with pytest.raises(ValueError, match="no run"):
        Runs(spark, path).table("lines")
    runs = Runs(spark, path)
    runs.update(_pages(spark, docs), catalog, domains, _meta(spark, docs))
    before = _rows(runs.table("nodes"))

    def fails(headings):
        raise RuntimeError("no model today")

    more = docs | {"b": [_text("b")]}
    with pytest.raises(Exception, match="no model today"):
        runs.update(_pages(spark, more), catalog, domains, _meta(spark, more), level_hook=fails, version="x")
    assert (tmp_path / "lines/run=2").exists() and _rows(Runs(spark, path).table("nodes")) == before
    assert {r.stem for r in Runs(spark, path).table("lines").select("stem").distinct().collect()} == {"a"}
    other = Runs(spark, path)
    assert runs.update(_pages(spark, more), catalog, domains, _meta(spark, more)).run == 2
    with pytest.raises(RuntimeError, match="another run"):
        other.update(_pages(spark, more), catalog, domains, _meta(spark, more))
    assert runs.table("lines").select("stem").distinct().count() == 2


def test_content_hashes_tell_pages_apart(spark):
    sets = {"a": ["x", "y"], "b": ["y", "x"], "c": ["x"], "d": ["x", "y", None], "e": ["x", "y"]}
    got = {r.stem: r.hash for r in content_hash(_pages(spark, sets)).collect()}
    assert got["a"] == got["e"] and len(set(got.values())) == 4


def test_many_keys_are_joined(spark, monkeypatch):
    edges = spark.createDataFrame([(f"s{k % 7}", f"t{k}", "K") for k in range(50)], "source string, target string, type string")
    table, keys = ad.by_key(edges, "source"), spark.createDataFrame([("s1",), ("s3",), (None,), ("s1",)], "k string")
    want = _rows(edges.filter("source IN ('s1', 's3')"))
    assert _rows(ad.of_keys(table, "source", keys)) == want
    monkeypatch.setattr(ad, "MOST", 1)
    assert _rows(ad.of_keys(table, "source", keys)) == want


def test_command_line_follows_a_folder(spark, tmp_path, capsys):
    """update, update again with one file changed, and questions to the folder, with a stored index and with one that is behind."""
    from clausemill.__main__ import main

    pages, config, out = tmp_path / "in", tmp_path / "config", str(tmp_path / "out")
    layer = config / "ontology" / "global"
    layer.mkdir(parents=True)
    (layer / "domains.yaml").write_text("domains:\n  - {label: Prudential, token: P}\n")
    (layer / "concepts.yaml").write_text("concepts:\n  - {canonical_id: C, label: Collateral, synonyms: [records]}\n")
    pages.mkdir()
    for name in ("a", "b"):
        (pages / f"{name}.txt").write_text(_text(name))
    given = ["update", "--pages", str(pages), "--config", str(config), "--out", out]
    main([*given, "--index"], spark)
    assert "2 read, 0 gone, state 1" in capsys.readouterr().out
    stored = Runs(spark, out).top_scores("collateral records", 2)
    main(["search", "--out", out, "--query", "collateral"], spark)
    assert "Title a" in (said := capsys.readouterr().out) and "|   b|" in said
    want = {(r.stem, r.ord, round(r.score, 9)) for r in stored.collect()}
    assert want == {(r.stem, r.ord, round(r.score, 9)) for r in ix.sparse_scores(Runs(spark, out).table("postings"), Runs(spark, out).idf(), "collateral records").collect()} and want
    (pages / "a.txt").write_text(_text("a", "and liquidity ratios"))
    (pages / "b.txt").unlink()
    main(given, spark)
    assert "1 read, 1 gone, state 2" in capsys.readouterr().out
    assert Runs(spark, out).stored_index() is None
    main(["answer", "--out", out, "--query", "liquidity ratios"], spark)
    assert "Title a" in capsys.readouterr().out
