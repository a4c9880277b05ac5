"""The pipeline's stages against plain versions, each on its own input, and the registry."""

from __future__ import annotations

import brute
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from clausemill.llm.quality_rules import quality_report
    from clausemill.llm.shared import settle

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in pipeline.STAGES:
        at[name] = (docs, docs := settle(stage(spark, docs, sf)))
        assert name == "sentencepiece" or docs.columns == columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before, after = map(rows, at["quality rules"])
    kept = {r.doc_id for r in quality_report(at["quality rules"][0]).filter("kept").collect()}
    assert set(after) == kept and all(after[k] == before[k] for k in after)
    assert not any(brute.measures(r.text)[-1] for r in after.values())
    before, after = map(rows, at["line dedup"])
    want = {k: t for k, _, _, t in brute.line_dedup([(k, r.text) for k, r in before.items()])}
    assert {k: r.text for k, r in after.items()} == want
    before, after = map(rows, at["near duplicates"])
    group = brute.similar_groups([(k, r.text) for k, r in before.items()])
    assert set(after) == {k for k, g in group.items() if k == g}
    before, after = map(rows, at["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = [(i, " ".join(brute.words(brute.ascii_lower(t)))) for i, t in items]
    held = {k for k, r in before.items() if any(f" {t} " in f" {' '.join(brute.words(brute.ascii_lower(r.text)))} " for _, t in exact)}
    assert held and not held & set(after)
    assert all(brute.leaks(before[k].text, items) for k in set(before) - set(after))
    before, after = map(rows, at["sentencepiece"])
    assert set(after) == set(before) and all(r.lossless and len(r.token_ids) == r.n_pieces for r in after.values())


def test_run_is_the_stages(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns[-3:] == ["n_pieces", "token_ids", "lossless"]


def test_registry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
