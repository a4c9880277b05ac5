"""Order in two levels, bounded prefixes, neighbours, similarity bounds and ledgers against plain versions."""

from __future__ import annotations

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.functions.python import display_pair, similar
from clausemill.operators import extract
from clausemill.operators import structure as st
from clausemill.operators.scan import following, running
from clausemill.sources import readers


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_two_levels_equal_one_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), k * rnd.choice([1, 1, 5]) + 100_000 * k, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y"])) for k in range(300)]
    df = spark.createDataFrame(rows, "stem string, ord long, n long, s string")
    for inclusive in (True, False):
        values = {"total": ("sum", F.col("n")), "latest": ("last", F.col("s")), "where": ("last", F.when(F.col("n") == 2, F.col("ord")))}
        want = _rows(running(df, ["stem"], "ord", values, inclusive))
        for segment in (1, 700_000, 10**9):
            assert _rows(running(df, ["stem"], "ord", values, inclusive, segment)) == want


def test_one_long_document_is_split(spark):
    """200,000 lines of one document: the tree is that of the windows, and no task of the scans has more than a few segments."""
    kinds = ["concat('## ', id % 97, '. Title')", "concat('## ', id % 13, '.', id % 7, ' Sub')", "'## Annex details'", "concat('<!-- Page ', id, ' -->')", "concat('body ', id)"]
    lines = spark.range(200_000).select(F.lit("d").alias("stem"), F.col("id").alias("line_no"), F.expr(f"CASE xxhash64(id) % 40 WHEN 0 THEN {kinds[0]} WHEN 1 THEN {kinds[1]} WHEN 2 THEN {kinds[2]} WHEN 3 THEN {kinds[3]} ELSE {kinds[4]} END").alias("raw"))
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    assert digest(st.build_structure(lines, segment=20_000)) == digest(st.build_structure(lines))
    marked = running(lines, ["stem"], "line_no", {"page": ("last", F.length("raw"))}, segment=20_000)
    windows = [x for x in marked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert len(windows) == 2 and "__part" in windows[0] and "__part" in windows[1]


def test_first_characters_stop_at_the_limit(spark):
    rnd = random.Random(2)
    docs = {s: [(p * rnd.choice([1, 9]) + 50 * p, rnd.choice([None, "", "é" * rnd.randint(0, 30), "word " * rnd.randint(0, 40)])) for p in range(rnd.randint(1, 40))] for s in ("a", "b", "c", "d")}
    pages = spark.createDataFrame([(s, p, t) for s, x in docs.items() for p, t in x], schemas.PAGES)
    for limit in (1, 2, 17, 400, 10**6):
        want = {s: "\n\n".join(t or "" for _, t in sorted(x))[:limit] for s, x in docs.items()}
        assert {r.stem: r.text for r in extract.first_chars(pages, limit, segment=64).collect()} == want


def test_neighbours_by_rank(spark):
    ids = [-70_000, -1, 0, 3, 65_535, 65_536, 10**9, 10**9 + 7]
    got = {r.k: r.next for r in following(spark.createDataFrame([(k, "x") for k in ids], "k long, other string"), "k", "k").collect()}
    assert got == dict(zip(ids, [*ids[1:], None], strict=True))


def test_similarity_bounds_settle_as_the_ratio_does(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    pairs = [(rnd.choice([None, *base]), rnd.choice([None, *base])) for _ in range(100)]
    for x in base:
        y = list(x)
        for _ in range(rnd.randint(0, 8)):
            y[rnd.randrange(len(y) + 1) : rnd.randrange(len(y) + 1)] = rnd.choice(["", "a", "zz"])
        pairs.append((x, "".join(y)))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for limit in (0.0, 0.5, 0.85, 1.0):
        got = {r.k: r.s for r in df.select("k", similar(F.col("a"), F.col("b"), limit).alias("s")).collect()}
        assert got == {k: difflib.SequenceMatcher(None, a or "", b or "").ratio() > limit for k, (a, b) in enumerate(pairs)}
    shown = {r.k: tuple(r.p) for r in df.select("k", display_pair(F.col("a"), F.col("b")).alias("p")).collect()}
    for k, (a, b) in enumerate(pairs):
        same = not b or (a and difflib.SequenceMatcher(None, a, b).ratio() > 0.85)
        assert shown[k] == ((a, None) if same else (b, None) if not a else (a, b))


def test_next_text_ratio_with_gaps_in_ids(spark, tmp_path):
    from clausemill.queries.documents import near_duplicate_ratio

    texts = {3: "one text of some words", 4: "one text of some word", 90: "another", 70_000: None, 70_001: "", 900_000: "another one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids, want = sorted(texts), {}
    for a, b in zip(ids, ids[1:], strict=False):
        ratio = difflib.SequenceMatcher(None, texts[a] or "", texts[b] or "").ratio()
        want[a] = (b, ratio > 0.85, round(ratio, 6) if ratio > 0.85 else None)
    assert {r.doc_id: (r.next_id, r.similar, r.ratio) for r in near_duplicate_ratio(spark, str(tmp_path)).collect()} == want


def test_a_ledger_remembers_what_was_told(spark, tmp_path):
    ledger, asked = str(tmp_path / "ledger"), tmp_path / "asked"
    asked.mkdir()
    urls = spark.createDataFrame([(f"u{k}",) for k in range(40)] + [("u1",), (None,), ("bad",)], "url string")

    def fetch(url, stop=True):
        with open(asked / f"{url}-{os.urandom(4).hex()}", "w"):
            pass
        if url == "bad":
            raise ValueError("no such page")
        if stop and url == "u39":
            raise KeyboardInterrupt  # the process is stopped
        return url.upper()

    with pytest.raises(Exception, match="KeyboardInterrupt"):
        readers.fetch_with_ledger(urls.coalesce(1), fetch, ledger, per_task=4)
    first = {r.url for r in readers.fetched(spark, ledger).filter("html IS NOT NULL").collect()}
    got = {r.url: (r.attempt, r.html, r.error) for r in readers.fetch_with_ledger(urls, lambda u: fetch(u, False), ledger, per_task=4).collect()}
    assert got.pop("bad") == (3, None, "ValueError: no such page") and got.keys() == {f"u{k}" for k in range(40)}
    assert all(html == u.upper() and error is None for u, (_, html, error) in got.items())
    times = {}
    for name in os.listdir(asked):
        times[name.rsplit("-", 1)[0]] = times.get(name.rsplit("-", 1)[0], 0) + 1
    assert first and all(times[u] == 1 for u in first) and max(v for u, v in times.items() if u != "bad") <= 2 and times["bad"] <= 4
    n = len(os.listdir(asked))
    readers.fetch_with_ledger(urls, fetch, ledger)
    assert len(os.listdir(asked)) == n
