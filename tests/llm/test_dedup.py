"""Substring, line and near-duplicate removal against plain versions and on odd inputs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.cuckoo import CuckooFilter
from clausemill.llm.line_dedup import LineIndex, drop_lines, index_lines
from clausemill.llm.shared import names
from clausemill.llm.simhash_dedup import fingerprints, near_duplicates, near_links
from clausemill.llm.substring_dedup import dedup_substrings

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here"), (5, "same words here"), (6, "a " * 200), (None, "null id text " * 30), (7, "Ünïcode ☃ \x00 text\u2028mark\u00a0joined")]


def _passages(seed: int, n: int = 60) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 60))) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 50))) for _ in range(3)]
        if rnd.random() < 0.7:
            parts.insert(rnd.randint(0, 3), rnd.choice(shared))
        rows.append((k, rnd.choice([" ", "\n", "  \t"]).join(parts)))
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1])]


@pytest.mark.parametrize("width", [2, 5, 12, 35])
def test_substrings_like_brute_force(make, width):
    rows = _passages(width)
    got = dedup_substrings(make(rows), width=width).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(rows, width))


def test_substrings_odd(make):
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = sorted((tuple(r) for r in dedup_substrings(make(ODD), width=5).collect()), key=key)
    assert got == sorted(brute.substring_dedup(ODD, 5), key=key)
    assert dedup_substrings(make([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(make([(1, "x")]), width=1)


def test_substrings_held_everywhere_are_told_once_a_task():
    """A passage of every text: one row for each of its windows and task, however many slices; all its places are known."""
    import pyarrow as pa

    from clausemill.llm import substring_dedup as sub

    passage = " ".join(f"p{k}" for k in range(12))
    texts = [f"{passage} own{k} " + "x" * 40_000 for k in range(200)]  # four slices or more
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(200)), "mark": pa.array(range(200), pa.int32()), "text": texts})
    class Sketch:  # noqa: E306  everything is estimated repeated
        value = [np.full(1 << 17, 0xFF, np.uint8)] * 2

    out = pa.Table.from_batches(list(sub._candidates(iter([batch]), 6, 1 << 20, Sketch)))
    kinds = np.bincount(out.column("kind").to_numpy(), minlength=3)
    assert kinds[1] == 7 and out.filter(pa.compute.equal(out.column("kind"), 2)).column("id").value_counts().to_pylist() == [{"values": k, "counts": 1} for k in range(1, 200)]


def test_substrings_overloaded_sketch(make):
    """The smallest sketch lets more windows through, and changes nothing."""
    rows = _passages(3, 40)
    a = dedup_substrings(make(rows), width=6, max_cells=1).collect()
    assert sorted(map(tuple, a)) == sorted(brute.substring_dedup(rows, 6))


def test_substrings_long_text(make):
    """A text longer than one piece of the word stream; the repeat lies across the cut."""
    text = " ".join(f"u{k}" for k in range((1 << 20) + 200))
    again = " ".join(f"u{k}" for k in range((1 << 20) - 30, (1 << 20) + 30))
    got = {r.doc_id: r for r in dedup_substrings(make([(1, text), (2, again)]), width=35).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed) == ((1 << 20) + 200, 60, 60)


def test_lines_like_brute_force(make):
    rnd = random.Random(5)
    pool = [f"A line that is shared number {k} ÄÖ" for k in range(6)] + ["short", "", "exactly twenty chars"]
    rows = [(k, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else f"own line of document {k} {j}" for j in range(rnd.randint(0, 8)))) for k in range(50)]
    rows += [(50, "  a LINE that is shared number 1 ÄÖ\t"), (51, "A line that is shared number 1 äö")]
    docs = make(rows)
    got = index_lines(docs).apply(docs, keep=("doc_id",)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.line_dedup(rows))


def test_lines_odd_and_columns(make):
    docs = make([*ODD, *[(None, "a line that only null ids hold")] * 3, (8, "b line of nulls and one id"), (None, "b line of nulls and one id"), (None, "b line of nulls and one id")])
    out = drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = sorted(r.text for r in out.filter("doc_id IS NULL").collect())
    assert texts == ["a line that only null ids hold"] * 3 + ["b line of nulls and one id"] * 2 + ["null id text " * 30]  # one document of nulls, or two in all
    assert out.filter("doc_id = 8 AND text <> ''").count() == 1
    assert {(r.n_chars, len(r.text)) for r in out.collect()} == {(len(r.text),) * 2 for r in out.collect()}
    assert drop_lines(docs.limit(0)).count() == 0


def test_lines_beyond_the_filter_bound(make):
    rows = [(k, "one line that they all have\nand one line that is " + str(k)) for k in range(9)]
    docs = make(rows)
    for bound in ({"max_filter_bytes": 0}, {"max_keys": 0}, {}):
        got = index_lines(docs, **bound).apply(docs, keep=("doc_id",)).collect()
        assert sorted(map(tuple, got)) == sorted(brute.line_dedup(rows))


def test_lines_of_repeated_ids_count_once(spark, make):
    """Rows 1, 1 and 2 are two documents; null ids are one.  The rule is that of the query's SQL."""
    import duckdb

    from clausemill.llm import queries as q

    line = "one line that all of these rows hold"
    for ids in ([1, 1, 2], [1, 1, 2, 3], [None, None, 2], [None, None, 2, 3], [None] * 5):
        rows = [(k, line) for k in ids] + [(9, "another")]
        docs = make(rows)
        got = sorted(((r.doc_id is None, r.doc_id, *r[1:]) for r in index_lines(docs).apply(docs, keep=("doc_id",)).collect()), key=str)
        assert got == sorted(((k is None, k, *r) for k, *r in brute.line_dedup(rows)), key=str)
        if None not in ids:
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            dropped = dict(con.sql(f"SELECT doc_id, sum(n_dropped) FROM ({q._OP7}) GROUP BY 1").fetchall())
            want: dict = {}
            for k, _, n, _ in brute.line_dedup(rows):
                want[k] = want.get(k, 0) + n
            assert dropped == want


def test_line_index_is_reversible(spark, make, tmp_path):
    shared = "one line that many documents hold"
    first, more = [(k, f"{shared}\nown {k}") for k in range(4)], [(k, f"{shared}\nown {k}") for k in range(10, 13)]
    index = LineIndex(spark, str(tmp_path))
    assert index.insert("a", make(first))
    before = [tuple(r) for r in index.frequent().collect()]
    assert index.insert("b", make(more)) and not index.insert("b", make(more))  # again: without effect
    assert index.insert("b2", make(more))  # the same documents in another batch: they count once
    assert [(r.n_docs, r.keep) for r in index.frequent().collect()] == [(7, 12)]
    assert index.delete("c", make(more)) and not index.delete("c", make(more))
    assert [tuple(r) for r in index.frequent().collect()] == before
    index.delete("d", make(first[:2]))
    assert index.frequent().count() == 0
    left = make(first[2:])
    index.vacuum()
    assert sorted(map(tuple, index.apply(left, keep=("doc_id",)).collect())) == sorted(brute.line_dedup(first[2:]))
    filters = [CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()]
    assert filters and all(not f.slots.any() for f in filters)


def test_line_index_opened_anew(spark, make, tmp_path):
    """Each step by another object: the folder is the state.  The largest holder goes, and the passage stays in one document."""
    shared = "one line that many documents hold"
    first, more = [(k, f"{shared}\nown {k}\nanother line of batch a here") for k in range(5)], [(5, f"{shared}\nown 5")]
    LineIndex(spark, str(tmp_path)).insert("a", make([*first, (99, f"{shared}\nown 99")]))
    LineIndex(spark, str(tmp_path)).delete("b", make([(99, "")]))
    LineIndex(spark, str(tmp_path)).insert("c", make(more))
    again = LineIndex(spark, str(tmp_path))
    assert sorted((r.n_docs, r.keep) for r in again.frequent().collect()) == [(5, 4), (6, 5)]
    docs = make(first + more)
    assert sorted(map(tuple, again.apply(docs, keep=("doc_id",)).collect())) == sorted(brute.line_dedup(first + more))
    held = [CuckooFilter.from_bytes(bytes(r["filter"])) for r in again.filters.collect()]
    assert sum(int((f.slots > 0).sum()) for f in held) == 2


def test_line_index_merges_its_tables_and_doubles_its_shards(spark, make, tmp_path):
    """Seven batches, one that deletes: tables of 4, 2 and 1 batches, more shards than at first, and the counts of all documents that are left."""
    rnd, held = random.Random(3), {}
    index = LineIndex(spark, str(tmp_path), shards=1, shard_keys=4)
    for n in range(7):
        if n == 3:
            gone = sorted(held)[:3]
            assert index.delete(f"b{n}", make([(k, "") for k in gone]))
            held = {k: x for k, x in held.items() if k not in gone}
        else:
            rows = [(100 - 10 * n + j, "\n".join(f"line number {rnd.randrange(24)} of the corpus" for _ in range(8))) for j in range(4)]
            assert index.insert(f"b{n}", make(rows))
            held.update(rows)
        index.vacuum()
        if n in (2, 3, 6):
            holders: dict = {}
            for k, text in held.items():
                for line in set(text.split("\n")):
                    holders.setdefault(line, set()).add(k)
            assert sorted((r.n_docs, r.keep) for r in index.frequent().collect()) == sorted((len(x), max(x)) for x in holders.values() if len(x) >= 3)
            for bound in ({}, {"max_keys": 0}):
                again = LineIndex(spark, str(tmp_path), shards=1, shard_keys=4, **bound)
                assert sorted(map(tuple, again.apply(make(list(held.items())), keep=("doc_id",)).collect())) == sorted(brute.line_dedup(list(held.items())))
    assert [n for _, n in index._last()["runs"]] == [4, 2, 1] and index._last()["shards"] == 8
    assert len(names(spark, f"{tmp_path}/postings")) == 3


def test_line_index_of_two_writers(spark, make, tmp_path, monkeypatch):
    """Another writer's batch comes between reading the log and publishing: both batches count."""
    from clausemill.llm import line_dedup

    shared = "one line that many documents hold"
    rows = [(k, f"{shared}\nown {k}") for k in range(6)]
    publish, other = line_dedup.publish, LineIndex(spark, str(tmp_path))

    def late(*args):
        monkeypatch.setattr(line_dedup, "publish", publish)
        other.insert("b", make(rows[3:]))
        return publish(*args)

    monkeypatch.setattr(line_dedup, "publish", late)
    assert LineIndex(spark, str(tmp_path)).insert("a", make(rows[:3]))
    assert [(r.n_docs, r.keep) for r in other.frequent().collect()] == [(6, 5)]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    f = CuckooFilter(5000)
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 2**63, 20000, dtype=np.uint64)).mean() < 0.01
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    tight = CuckooFilter(5000)
    more = rng.integers(0, 2**63, int(tight.slots.size * 0.93), dtype=np.uint64)
    tight.insert(more)
    assert not tight.open and tight.contains(more).all() and (tight.slots > 0).sum() == len(more)
    tight.delete(more)
    assert not tight.slots.any()
    full = CuckooFilter(1)
    full.insert(keys)
    assert full.open and full.contains(keys).all() and CuckooFilter.from_bytes(full.to_bytes()).open


def test_fingerprints_like_brute_force(make):
    rows = [*_passages(9, 20), *[r for r in ODD if r[0] is not None]]
    got = {(r.id, r.fp & (2**64 - 1)) for r in fingerprints(make(rows)).collect()}
    assert got == {(k, brute.fingerprint(t)) for k, t in rows}


def test_near_links_sparse_and_crowded(spark):
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    for p in prints[:60]:
        prints += [p ^ (1 << rnd.randrange(64)), p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))]
    center = rnd.getrandbits(64) & ~0b1111
    prints += [center ^ (1 << a) ^ (1 << b) for a in range(0, 24) for b in range(a)]  # a crowd around one point
    lone = rnd.getrandbits(64) & ~0xFFFFFFFF | 0x55555555  # 2^12 at one point, in two parts three bits apart or more
    prints += [lone ^ sum(3 << 2 * b for b in range(12) if k >> b & 1) for k in range(1 << 12) if k.bit_count() % 3]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    pairs = {(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in links.collect()}
    assert all(1 <= (a ^ b).bit_count() <= 2 for a, b in pairs)
    numbered = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "k long, p long")
    named = links.join(numbered.toDF("ku", "u"), "u").join(numbered.toDF("kv", "v"), "v").select(F.col("ku").alias("u"), F.col("kv").alias("v"))
    found = {k: k for k in range(len(prints))} | {r.u: r.v for r in components(named).collect()}
    assert found == brute.groups(list(enumerate(prints)))


def test_links_of_a_point_over_many_batches():
    """A crowded point longer than a batch is sent on whole; the points beside it link as ever."""
    import pyarrow as pa

    from clausemill.llm import simhash_dedup as sd

    point = np.concatenate([[1, 1], np.full(250_000, 5), [9, 9]])
    fp = np.concatenate([[0, 1], np.arange(250_000) * 8, [16, 17]])
    batches = [pa.RecordBatch.from_pydict({"point": point[k : k + 30_000], "fp": fp[k : k + 30_000]}) for k in range(0, len(fp), 30_000)]
    out = [x for b in sd._links(iter(batches), 2) for x in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert {x for x in out if x[1] is not None} == {(1, 0), (17, 16)}
    assert sorted(u for u, v in out if v is None) == list(range(0, 2_000_000, 8))


def test_near_duplicates_odd(make):
    rows = [r for r in ODD if r[0] is not None]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(make(rows)).collect()}
    expected = brute.groups(list({k: brute.fingerprint(t) for k, t in rows}.items()))
    assert got == set(expected.items())
    assert near_duplicates(make(rows).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    n = 400
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1000), (2001, 2000)], "u long, v long")
    found = {r.u: r.v for r in components(links).collect()}
    assert found == {k: 0 for k in range(1, n + 1)} | {2001: 2000}
    assert components(links.limit(0)).count() == 0


def test_substrings_tell_null_ids_apart(spark, make):
    """Texts without ids whose 32-bit hashes are equal: one holds a passage that a third text holds, the other keeps its words."""
    tail = "one two three four five six"
    pairs = spark.range(400_000).selectExpr(f"concat('w', id, ' {tail}') AS t", "0 AS kind").union(spark.range(400_000).selectExpr("concat('v', id, ' x y z')", "1")).selectExpr("t", "kind", "hash(t) AS h")
    both = pairs.groupBy("h").agg(F.collect_set("kind").alias("kinds"), F.collect_list("t").alias("ts")).filter("size(kinds) = 2").select("ts").first()["ts"]
    assert len(both) == 2
    rows = [(None, both[0]), (None, both[1]), (9, f"other words {tail}")]
    got = {r.kept_text for r in dedup_substrings(make(rows), width=5).collect()}
    assert {t for t in both if t.startswith("v")} <= got and got == {r[3] for r in brute.substring_dedup(rows, 5)}


def test_names_with_dots(make):
    docs = make(ODD).withColumnRenamed("doc_id", "doc.id").withColumnRenamed("text", "the.text")
    assert dedup_substrings(docs, "doc.id", "the.text").count() == len(ODD) == near_duplicates(docs, "doc.id", "the.text").count()
