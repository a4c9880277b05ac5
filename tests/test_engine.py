"""Operators against plain models, and hooks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from clausemill import hooks, plans, schemas
from clausemill.operators import answer as an
from clausemill.operators import catalog as ct
from clausemill.operators import clauses as cl
from clausemill.operators import extract, graph, interpret, matching, news, structure, web
from clausemill.operators import index as ix
from clausemill.sources import html, readers, writers

RANKS = {"part": 1, "annex": 1, "section": 2, "clause": 1001}


def rank(kind, number):
    return 2 + max((number or "").count("."), 1) if kind == "subsection" else RANKS.get(kind)


def plain_parents(kinds):
    """Parents by a stack of open nodes."""
    out, open_ = [], []
    for k, (kind, number) in enumerate(kinds):
        r = rank(kind, number)
        if kind in ("part", "annex"):
            open_ = []
        elif r is not None:
            while open_ and open_[-1][0] >= r:
                open_.pop()
        out.append(open_[-1][1] if open_ else None)
        if r is not None:
            open_.append((r, k))
    return out


def test_parents_and_trails_like_a_stack(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for stem in range(150):
        kinds = [(kind, None if kind != "subsection" else rnd.choice([None, "1.1", "1.1.1", "2.3.4.5"])) for kind in (rnd.choice(structure.LEVELS) for _ in range(rnd.randint(1, 25)))]
        rows += [(f"s{stem}", k, kind, number, f"t{k}", None) for k, (kind, number) in enumerate(kinds)]
        parents = plain_parents(kinds)
        for k, p in enumerate(parents):
            trail, at = [], p
            while at is not None:
                kind, number = kinds[at]
                trail.insert(0, f"{kind} {number or ''} t{at}")
                at = parents[at]
            want[f"s{stem}", k] = (p, " > ".join(trail) or "(document root)")
    nodes = spark.createDataFrame(rows, "stem string, ord long, type string, number string, heading string, text string")
    out = structure.trails(structure.assign_parents(nodes))
    assert {(r.stem, r.ord): (r.parent_ord, r.trail) for r in out.collect()} == want


def _lines(spark, text):
    return spark.createDataFrame([("d", k, x) for k, x in enumerate(text.split("\n"))], schemas.LINES)


MARKDOWN = """preamble is lost
<!-- Page 2 -->
## PART I: Scope
body one

body two
<!-- Page 3 -->

## 1. First
## (a) own text
lost body
## Table 2: rates
row
## Something odd
below
## 1.1 Sub
text of sub
## 1. First
again"""


def test_structure(spark):
    nodes = {r.ord: r for r in structure.build_structure(_lines(spark, MARKDOWN)).collect()}
    assert [(nodes[k].type, nodes[k].number, nodes[k].heading, nodes[k].text, nodes[k].parent_ord) for k in range(1, 8)] == [
        ("part", "I", "Scope", "body one\nbody two", None), ("section", "1", "First", None, 1), ("clause", "(a)", None, "own text", 2),
        ("table", "2", "rates", "row", 3), ("clause", None, None, "Something odd", 2), ("subsection", "1.1", "Sub", "text of sub", 2), ("section", "1", "First", "again", 1),
    ]
    assert (nodes[1].page_start, nodes[1].page_end, nodes[2].page_start) == (2, 3, 3)
    events = structure.heading_events(structure.mark_lines(_lines(spark, MARKDOWN)))
    odd = structure.ambiguous(events).collect()
    assert [(r.raw_heading, r.prev_type, r.following_text) for r in odd] == [("Something odd", "table", "below")]
    for level, text in (("section", "below"), ("table", "Something odd"), ("nonsense", "Something odd")):
        done = structure.build_nodes(structure.resolve(events, lambda a, level=level: a.select("stem", "ord", F.lit(level).alias("level"))))
        assert done.filter("ord = 5").first().text == text
    assert {r.ord for r in structure.operative_units(structure.build_structure(_lines(spark, MARKDOWN))).collect()} == {1, 3, 4, 5, 6, 7} - {1}
    assert {r.ord for r in structure.leaves(structure.build_structure(_lines(spark, MARKDOWN))).collect()} == {4, 5, 6, 7}


def test_clauses(spark):
    domains = spark.createDataFrame([("T", "Label", "")], schemas.DOMAINS)
    out = cl.export_clauses(structure.build_structure(_lines(spark, MARKDOWN)), domains)
    assert [(r.clause_id, r.clause_no, r.semantic.domain) for r in out.orderBy("ord").collect()] == [("clause_1", "1", None), ("clause_1_1", "1.1", None), ("clause_1__2", "1", None)]
    assert tuple(cl.clause_counts(out).first()) == ("d", 3, 1, 2)
    x = cl.domain_tokens(spark.createDataFrame([("Label",), ("Else",), (None,)], "d string"), domains, "d")
    assert {r.d: r.domain_token for r in x.collect()} == {"Label": "T", "Else": "OTHER", None: None}


@pytest.fixture
def catalog(spark):
    rows = [(0, "C_GOV", "Governance", None, "Corporate", None, "approved", ["Board Duties", "governance"]), (1, "C_RISK", "Credit Risk Framework", None, "Prudential", "C_GOV", "draft", ["Risk Limits"]), (2, "C_COLL", "Collateral Monitoring", None, "Prudential", "C_RISK", "approved", [])]
    return spark.createDataFrame(rows, schemas.CONCEPTS)


@pytest.fixture
def domains(spark):
    return spark.createDataFrame([("CORP", "Corporate", ""), ("PRU", "Prudential", "")], schemas.DOMAINS)


def _clause_rows(spark, concepts, stem="d"):
    rows = [(stem, k, f"clause_{k}", str(k), f"title {k}", f"text {k}", 1, (dom, concept, "MONITOR", None, "Reporting", "Mandatory", 0.5)) for k, (concept, dom) in enumerate(concepts)]
    return spark.createDataFrame(rows, schemas.CLAUSES)


def test_matching(spark, catalog, domains):
    concepts = {"Governance": ("C_GOV", "exact_label", 1.0), " board   DUTIES ": ("C_GOV", "synonym", 0.95), "Risk Limits.": ("C_RISK", "normalized", 0.85), "collateral monitored zzz": (None, "unmapped", 0.0), "monitor collaterals": ("C_COLL", "fuzzy", 0.85), "nothing known": (None, "unmapped", 0.0), "": (None, "unmapped", 0.0)}
    out = {r.concept: (r.canonical_id, r.match_type, r.base_confidence) for r in matching.match_concepts(spark.createDataFrame([(c,) for c in concepts], "concept string"), catalog).collect()}
    out["collateral monitored zzz"] = concepts["collateral monitored zzz"] if out["collateral monitored zzz"][1] in ("fuzzy", "unmapped") else None
    assert out == concepts
    objects = matching.ontology_objects(_clause_rows(spark, [("Governance", "CORP"), ("Governance", "PRU"), ("Governance", None), ("Credit Risk Framework", "PRU"), ("nothing", "PRU"), (None, "PRU")]), catalog, domains)
    got = {r.ord: (r.canonical_id, r.match_confidence, r.review_required) for r in objects.collect()}
    assert got == {0: ("C_GOV", 1.0, False), 1: ("C_GOV", 0.8, True), 2: ("C_GOV", 1.0, False), 3: ("C_RISK", 1.0, True), 4: (None, 0.0, True)}
    assert tuple(matching.coverage(objects).first()) == ("d", 5, 4, 1, 80.0, 3, 0)
    assert tuple(matching.coverage(objects.limit(0), None).first()) == (0, 0, 0, 0.0, 0, 0)
    replies = matching.suggest(objects, catalog, lambda words, entries: [{"concept": w, "canonical_id": entries[0][0], "confidence": c} for w in words for c in ("0.7", "bad", 1.4)])
    filled = matching.ontology_objects(_clause_rows(spark, [("nothing", "PRU"), ("Governance", "CORP")]), catalog, domains, suggestions=replies)
    assert [(r.canonical_id, r.suggested_canonical_id, r.suggestion_confidence) for r in filled.orderBy("ord").collect()] == [(None, "C_GOV", 1.0), ("C_GOV", None, None)]
    broken = matching.suggest(objects, catalog, lambda words, entries: 1 / 0)
    assert broken.count() == 0


def test_catalog_layers(spark):
    base = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B"), ("c", 2, "C")], "key string, position int, label string")
    extra = spark.createDataFrame([("d", 0, "D"), ("b", 1, "B2")], "key string, position int, label string")
    rows = ct.merge_by_key(base, extra, "key", "position").orderBy("merged_position").collect()
    assert [(r.key, r.label) for r in rows] == [("a", "A"), ("b", "B2"), ("c", "C"), ("d", "D")]
    registry = spark.createDataFrame([("CB", "X_CB")], "regulator string, code string")
    docs = spark.createDataFrame([(" CB ",), ("cb",), (None,)], "regulator string")
    assert [r.pack for r in ct.registry_pack(docs, registry).collect()].count("X_CB") == 1


def test_catalog_files(spark, tmp_path, monkeypatch):
    for layer, concept in (("global", "Base"), ("jurisdictions/XX", "Own")):
        folder = tmp_path / "ontology" / layer
        folder.mkdir(parents=True)
        (folder / "domains.yaml").write_text("domains:\n  - {label: L, token: T}\n")
        (folder / "concepts.yaml").write_text(f"concepts:\n  - {{canonical_id: C, label: {concept}, synonyms: [x]}}\n  - {{canonical_id: {concept}, label: y}}\n")
    got = ct.load_catalog(spark, str(tmp_path), "XX")
    assert [(r.canonical_id, r.label, r.cat_ord) for r in got["concepts"].orderBy("cat_ord").collect()] == [("C", "Own", 0), ("Base", "y", 1), ("Own", "y", 2)]
    with pytest.raises(FileNotFoundError):
        ct.load_catalog(spark, str(tmp_path), "YY")
    monkeypatch.delenv("CLAUSEMILL_CONFIG", raising=False)
    assert ct.config_root(None, str(tmp_path), "/pack").as_posix() == "/pack"
    monkeypatch.setenv("CLAUSEMILL_CONFIG", "/env")
    assert ct.config_root(None, str(tmp_path), "/pack").as_posix() == "/env" and ct.config_root("/arg", "x", "y").as_posix() == "/arg"


def test_whole_run_and_answer(spark, catalog, domains, tmp_path):
    pages = spark.createDataFrame([(s, p, f"1. Title {s}\nAll banks keep collateral records.\n2. Other\nmore text about lending {s}") for s in ("a", "b") for p in (1, 2)], schemas.PAGES)
    meta = spark.createDataFrame([(s, None if s == "a" else "B-1", "CB", "XX", f"Doc {s}", "law", None, None, "g=1") for s in ("a", "b")], "stem string, document_id string, regulator string, regulator_country string, title string, source_type string, version string, jurisdiction string, catalog_version string")
    classifier = lambda units: [{"index": u["index"], "domain": "Prudential", "concept": "Collateral Monitoring", "action": " MONITOR", "obligation_type": "Reporting", "mandatory_flag": "Mandatory", "confidence_score": "1.7"} for u in units if u["index"] != 1]
    corpus = plans.run(str(tmp_path), pages, catalog, domains, meta, classifier=classifier)
    tagged = {(r.stem, r.ord): r for r in corpus.nodes.collect()}
    assert tagged["a", 1].action == "OTHER" and tagged["a", 1].confidence_score == 1.0 and tagged["a", 2].action is None and tagged["a", 2].is_operative
    assert corpus.clauses.count() == 8 and corpus.objects.count() == 6
    nodes, edges = graph.union_graphs(corpus.graph_nodes, corpus.graph_edges)
    stats = {(r.what, r.type): r.n for r in graph.graph_stats(nodes, edges).collect()}
    assert stats["node", "Document"] == 2 and stats["node", "Regulator"] == 1 and stats["node", "Concept"] == 2 and stats["edge", "CHILD_OF"] == 2 and stats["edge", "HAS_CLAUSE"] == 8
    twice = graph.union_graphs(corpus.graph_nodes.union(corpus.graph_nodes), edges)[0]
    assert twice.count() == nodes.count()
    hits = ix.retrieve(corpus.postings, corpus.clauses, "collateral records a", k=3).join(corpus.clauses.select("stem", "ord", "clause_id", "clause_no", "title"), ["stem", "ord"]).withColumn("document_id", F.when(F.col("stem") == "a", "a").otherwise("B-1")).filter("stem = 'a'")
    docs = spark.createDataFrame([("a", "a"), ("B-1", "b")], "document_id string, stem string")
    got = an.answer("q", hits.drop("stem", "ord"), corpus.clauses, nodes, edges, docs, synthesizer=lambda q, rows: f"As said [a {rows[0]['clause_no']}] and [x 9.9].")
    evidence = got.evidence.collect()
    assert evidence and all(r.canonical_id == "C_COLL" and r.concept_parent == "Credit Risk Framework" and r.obligation_type == "Reporting" for r in evidence if r.canonical_id)
    assert {r.document_id for r in got.impact.collect()} == {"B-1"}
    assert [r.citation for r in got.ungrounded.collect()] == ["[x 9.9]"]
    assert got.confidence.first().retrieval_band in ("High", "Medium", "Low") and got.path.first().path[0].startswith("Retrieved")
    assert an.evidence_view(got.evidence).count() == len(evidence)
    told = {(r.stem, r.step, r.what): r.n for r in plans.summaries(plans.load(spark, str(tmp_path))).collect()}
    assert told["a", "structure", "section"] == 4 and told["b", "clauses", "clauses"] == 4 and told["a", "objects", "fuzzy" if ("a", "objects", "fuzzy") in told else "exact_label"] == 3
    from clausemill.__main__ import main

    main(["search", "--out", str(tmp_path), "--query", "collateral"], spark)
    main(["answer", "--out", str(tmp_path), "--query", "collateral", "--stem", "a"], spark)
    nothing = an.answer("q", hits.drop("stem", "ord").limit(0), corpus.clauses, nodes, edges, docs)
    assert nothing.confidence.first().top_score == 0 and nothing.answer is None


def test_index(spark):
    rows = spark.createDataFrame([("d", 0, "alpha beta beta"), ("d", 1, "alpha"), ("d", 2, "the of"), ("e", 0, "gamma alpha")], "stem string, ord long, text string")
    post = ix.postings(rows, F.col("text"))
    idf = {r.term: r.idf for r in ix.document_idf(post, rows).filter("stem = 'd'").collect()}
    assert idf["beta"] == pytest.approx(1.6931471805599454) and idf["alpha"] == pytest.approx(1.2876820724517808)
    assert [(r.stem, r.ord, r.score) for r in ix.retrieve(post, rows, "alpha").collect()][0] == ("d", 1, 1.0)
    assert ix.retrieve(post, rows, "the unknown").count() == 0
    assert {(r.stem, r.clause_count, r.vocabulary_size) for r in ix.index_meta(post, rows).collect()} == {("d", 3, 2), ("e", 1, 2)}
    assert {r.ord: r.terms for r in ix.term_map(post).filter("stem = 'd'").collect()} == {0: {"alpha": 1, "beta": 2}, 1: {"alpha": 1}}
    vectors = ix.embed(rows, hooks.hashed_embedder)
    query = spark.createDataFrame([(vectors.filter("stem = 'd' AND ord = 1").first().vector,)], "query array<double>")
    assert [(r.stem, r.ord) for r in ix.top_hits(None, ix.dense_scores(vectors, query), 1).collect()] == [("d", 1)]


def test_backends_and_providers(spark, monkeypatch):
    asked = []

    def odd(texts, is_query):  # replies in any order, as a service gives them
        asked.append((len(texts), is_query))
        return [{"index": k, "embedding": v} for k, v in reversed(list(enumerate(hooks.hashed_embedder(texts))))]

    rows = spark.createDataFrame([("d", k, "", f"text {'alpha' if k % 3 else 'beta gamma'} {k}", None) for k in range(10)], "stem string, ord long, title string, text string, semantic struct<concept:string,object:string>")
    monkeypatch.delenv("CLAUSEMILL_EMBEDDER", raising=False)
    one, other = ix.backend("embedding", {"azure": odd, "nvidia": hooks.hashed_embedder}), ix.backend("nvidia", {"azure": odd, "nvidia": hooks.hashed_embedder})
    assert (one.name, other.name, one.dense) == ("azure", "nvidia", True)
    assert sorted(map(str, one.build(rows).collect())) == sorted(map(str, other.build(rows).collect()))
    hits = {r.ord for r in ix.top_hits(None, one.scores(one.build(rows), rows, "beta gamma"), 4).collect()}
    assert hits == {0, 3, 6, 9} and asked == [(1, True)]
    sparse = ix.backend("tfidf")
    assert not sparse.dense and {r.ord for r in sparse.scores(sparse.build(rows), rows, "beta").collect()} == {0, 3, 6, 9}
    monkeypatch.setenv("CLAUSEMILL_EMBEDDER", "nvidia")
    assert ix.backend("embedding", {"azure": odd, "nvidia": hooks.hashed_embedder}).name == "nvidia"
    for name, configured in (("azure", {"nvidia": odd}), ("embedding", {"azure": odd}), ("embedding", {})):
        with pytest.raises(LookupError):
            ix.backend(name, configured)
    with pytest.raises(ValueError):
        ix.backend("other")
    with pytest.raises(ValueError, match="2 texts, 1 vectors"):
        ix.in_order([[1.0]], 2)


def test_stored_weights_like_retrieve(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(f"s{k % 3}", k, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rare"]) for _ in range(rnd.randint(1, 9)))) for k in range(60)], "stem string, ord long, text string")
    post = ix.postings(rows, F.col("text"))
    idf = ix.corpus_idf(post, rows)
    weights = ix.stored_weights(post, idf)
    for query in ("alpha beta beta", "rare", "the unknown", "gamma unknown"):
        assert ix.top_hits(ix.stored_scores(weights, idf, query), None).collect() == ix.retrieve(post, rows, query).collect()


def test_fuzzy_pruned_like_whole(spark):
    rnd = random.Random(9)
    words = ["common", *[f"word{k}" for k in range(25)]]
    phrase = lambda: " ".join(["common", *(rnd.choice(words) for _ in range(rnd.randint(1, 4)))])
    catalog = spark.createDataFrame([(k, f"C{k}", phrase(), None, None, None, None, [phrase()]) for k in range(30)], schemas.CONCEPTS)
    concepts = spark.createDataFrame([(x,) for x in sorted({phrase() for _ in range(60)} | {"nothing known"})], "concept string")
    whole = {r.concept: (r.fuzzy_id, r.similarity) for r in matching.fuzzy_best(concepts, catalog).collect()}
    for least in (0.3, 0.62, 0.9):
        assert {r.concept: (r.fuzzy_id, r.similarity) for r in matching.fuzzy_best(concepts, catalog, least=least).collect()} == {c: x for c, x in whole.items() if x[1] >= least}


def test_json_schema_rules(spark):
    schema = {"type": "object", "required": ["a", "n"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 2}, "n": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}}, "c": {"const": "z"}}}
    rows = spark.createDataFrame([(1, "ab", ("3", ["x"]), None), (2, "a", ("3.5", ["x", "q"]), "y"), (3, None, (None, None), "z")], "id int, a string, n struct<k:string,tags:array<string>>, c string")
    rules = ct.schema_rules(schema, ["a", "n", "c", "other"])
    got = {r.id: set(r.violations) for r in ct.violations(rows, rules, 99).collect()}
    odd = "other: not in the schema"
    assert got == {1: {odd}, 2: {"a: minLength", "n.k: type", "n.tags: items", "c: const", odd}, 3: {"a: required", "n.k: required", odd}}


def test_extract(spark):
    pages = spark.createDataFrame([("d", 1, "Good line here\n~1..i garbage<\n\nRBI 25%"), ("d", 2, "")], schemas.PAGES)
    assert {r.page_no: r.text for r in extract.denoise_pages(pages).collect()} == {1: "Good line here\n\nRBI 25%", 2: ""}
    lines = extract.split_lines(pages)
    assert tuple(extract.denoise_stats(lines, ["stem"]).first())[:2] == ("d", 4)
    assert extract.likely_scanned(pages).first().scanned
    odd = spark.createDataFrame([("x", 1, "a\r\nb c\x0bd\n")], schemas.PAGES)
    assert [r.raw for r in extract.split_lines(odd).orderBy("line_no").collect()] == ["a", "b", "c", "d"]
    md = extract.markdown_text(extract.markdown_lines(spark.createDataFrame([("d", 1, "1. Title\nbody  "), ("d", 2, "x")], schemas.PAGES))).first()
    assert md.markdown == "<!-- Page 1 -->\n\n## 1. Title\n\nbody\n\n<!-- Page 2 -->\nx\n" and md.total_sections == 1
    meta = extract.metadata(pages, overrides={"regulator": "CB", "title": ""}).first()
    assert (meta.regulator, meta.title, meta.total_pages, meta.business_domain) == ("CB", None, 2, "Unknown")
    log = spark.createDataFrame([("a", "x", "ok", None), ("a", "y", "skipped", None), ("b", "x", "failed", None)], schemas.RUN_LOG)
    assert {r.stem: r.extraction_status for r in extract.extraction_status(log).collect()} == {"a": "Success", "b": "Partial"}


def test_news(spark):
    story = '{"title":"T","url":"u","story_date":"2024-01-01","metrics":{"significance":0.5},"geo":{"country":"","region":"R"},"top_articles":[{"title":"a","url":"x","domain":"d"},{"title":"b","url":"x","domain":""},{"title":"c","url":"","domain":"e"}]}'
    texts = [f'Found: {{"data":[{story}]}}', '{"data":[],"stories":[{"title":"S"}]}', '{"data":{"no":"list"},"stories":[{"title":"S"}]}', "no brace", "{bad", '{"data":[{"title":"T"}]} tail']
    rows = news.payload_rows(spark.createDataFrame([("t", k, x) for k, x in enumerate(texts)], "topic string, part int, text string"))
    assert sorted((r.part, r.story.title) for r in rows.collect()) == [(0, "T"), (1, "S")]
    first = news.compact(rows.filter("part = 0")).first()
    assert (first.significance, first.sources) == (0.5, ["d", "e"])
    topics = spark.createDataFrame([("t", "q", 1, 1, "date"), ("empty", "q", 1, 1, "date")], schemas.TOPICS)
    out = {r.topic: r.markdown for r in news.digest(rows, topics).collect()}
    assert "### R\n- **T** ([story](u)) — 2024-01-01, significance 0.5\n  - [a](x) (d)" in out["t"] and "### Unknown\n- **S**" in out["t"]
    assert "No stories" in out["empty"]


DETAIL = """<table class="tablebg"><tr><td class="tableheader"><b>Old</b></td></tr><tr><td class="tableheader"><b>Title here</b></td></tr>
<tr><td class="tableheader">Date : Jan 1, 2024</td></tr><tr class="tablecontent2"><td><table class="td"><tr><td>Body <a href="/x">one</a> <a href="#f">f</a> <a href="/x">two</a><br>end</td></tr></table>
<a id="APDF_1" href=" f.pdf ">pdf</a><span id="SPDF_1"> 10 kb </span></td></tr></table>"""


def test_web(spark):
    page = html.detail_page("http://h/a", DETAIL)
    assert (page["title"], page["date"], page["pdf_url"], page["pdf_size"]) == ("Title here", "Jan 1, 2024", "f.pdf", "10 kb")
    assert page["linked_documents"] == [{"text": "one", "url": "http://h/x"}] and page["body_text"] == "Body\none\nf\ntwo\nend"
    frame = spark.createDataFrame([("http://h/a", DETAIL), ("http://h/b", None)], "url string, html string")
    assert {r.url: (r.title, r.error) for r in web.details(frame).collect()} == {"http://h/a": ("Title here", None), "http://h/b": (None, "no table.tablebg found on page")}
    rows = '<table class="tablebg"><tr><td class="tableheader">May 1</td></tr>' + "".join(f'<tr><td><a class="link2" href="n{k}">N{k}</a>{"" if k == 1 else f"<a id=APDF_{k} href=p{k}>p</a>"}</td></tr>' for k in range(3)) + "</table>"
    listing = spark.createDataFrame([("http://h/l", rows)], "url string, html string")
    assert [(r.date, r.title, r.pdf_url) for r in web.notifications(listing).orderBy("pos").collect()] == [("May 1", "N0", "p0"), ("May 1", "N2", "p2")]
    assert [r.link for r in web.listing(listing).orderBy("pos").collect()] == ["http://h/n0", "http://h/n1", "http://h/n2"]
    crawlable = spark.createDataFrame([("http://www.rbi.org.in/a/NotificationUser.aspx?x=1",), ("http://other/NotificationUser.aspx",), ("http://rbi.org.in/",), ("::bad",), (None,)], "u string").select(web.is_crawlable(F.col("u")).alias("c"))
    assert [r.c for r in crawlable.collect()] == [True, False, False, False, False]
    site = spark.createDataFrame([(f"http://s/{k}", k, f"http://s/x{k}") for k in range(5)], "url string, pos int, href string")
    pages = spark.createDataFrame([("http://s/x1", "one")], "url string, html string")
    for limit, n in ((None, 10), (2, 4)):  # so many seeds, and the page that each links to
        walked = web.crawl(site.select("url", "pos"), site.select("url", "href"), pages, limit, lambda u: F.contains(u, F.lit("/x"))).collect()
        assert len(walked) == n and [r.url for r in walked if r.html] == ["http://s/x1"]
    shown = {r.url: r.markdown for r in web.scrape_digest(web.details(frame)).collect()}
    assert shown["http://h/a"].startswith("## Title here\n\n- URL: http://h/a\n- Date: Jan 1, 2024") and "- Error: no table" in shown["http://h/b"]
    wanted = spark.createDataFrame([("http://a/x.pdf",), ("http://b/x.pdf?z",), ("http://b/y.pdf",)], "pdf_url string")
    stored = spark.createDataFrame([("y.pdf",)], "file_name string")
    assert web.missing_files(wanted, stored).count() == 1
    links = web.link_rows(spark.createDataFrame([(1, """<a href='x'>1</a><A HREF = "y z">2</A><a data-href=q href=w>3</a><a href="#t">""")], "k int, html string"), "k")
    assert [r.href for r in links.orderBy("pos").collect()] == ["x", "y z", "w"]
    assert web.contents(web.details(frame).withColumn("site", F.lit("s")), "site").first().markdown == "# Contents\n\n1. Title here\n2. http://h/b\n"
    with pytest.raises(ValueError):
        web.classification_table(wanted, ["nope"], ["pdf_url"], "pdf_url")


def test_files_and_stream(spark, tmp_path):
    from clausemill.streaming import ingest

    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "a.md").write_text(MARKDOWN)
    (folder / "b.md").write_text("## 1. Only\ntext")
    lines = readers.read_markdown(spark, str(folder))
    nodes = structure.build_structure(lines)
    writers.write_step(nodes, str(tmp_path / "nodes"))
    back = readers.read_corpus(spark, str(tmp_path / "nodes"), schemas.NODES, "b")
    assert [r.heading for r in back.collect()] == ["Only"]
    ingest(spark, str(folder), str(tmp_path / "streamed"), str(tmp_path / "ck")).awaitTermination(120)
    streamed = spark.read.schema(schemas.NODES).parquet(str(tmp_path / "streamed"))
    assert sorted(map(tuple, streamed.select("stem", "ord", "type").collect())) == sorted(map(tuple, nodes.select("stem", "ord", "type").collect()))
    (tmp_path / "p.pdf").write_bytes(b"one\fTwo")
    pages = readers.read_pages(spark, str(tmp_path / "p.pdf"))
    assert [(r.stem, r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [("p", 1, "one"), ("p", 2, "Two")]
    assert [r.processed for r in readers.list_documents(spark, str(tmp_path / "*.pdf")).collect()] == [False]
    fetched = readers.fetch_pages(spark.createDataFrame([("u",), ("u",), ("bad",)], "url string"), lambda u: u.upper() if u == "u" else 1 / 0)
    assert {r.url: r.html for r in fetched.collect()} == {"u": "U", "bad": None}
    found = readers.search_stories(spark.createDataFrame([("t", "q", 1, 1, "date")], schemas.TOPICS), lambda topic: [{"text": topic["name"]}])
    assert [tuple(r) for r in found.collect()] == [("t", 0, "t")]
    assert readers.safe_name("a.pdf") == "a.pdf"
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            readers.safe_name(bad)
    writers.append_log(spark.createDataFrame([("a", "x", "ok", None)], schemas.RUN_LOG), str(tmp_path / "log"))
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", spark.read.parquet(str(tmp_path / "log")).first().generated_at)
    shown = writers.as_json(back, ["stem"]).first().json
    assert '"heading":"Only"' in shown and '"parent_ord":null' in shown


def test_steps_in_buckets(spark, tmp_path):
    path = str(tmp_path / "step")
    rows = lambda *x: spark.createDataFrame(list(x), "stem string, n int")
    writers.write_step(rows(*((f"d{k}", j) for k in range(600) for j in range(2))), path)
    assert len([p for p in (tmp_path / "step").iterdir() if p.is_dir()]) <= writers.BUCKETS
    for _ in range(2):  # again: the same table
        writers.write_step(rows(("d1", 7), ("new", 8)), path)
        back = readers.read_corpus(spark, path, "stem string, n int")
        assert back.columns == ["stem", "n"] and back.count() == 600 * 2 - 2 + 2
        assert [r.n for r in readers.read_corpus(spark, path, "stem string, n int", "d1").collect()] == [7]


def test_files_are_stored_and_used_again(spark, tmp_path):
    path, log = str(tmp_path / "files"), tmp_path / "asked"
    log.mkdir()

    def fetch(url):
        (log / url.rsplit("/", 1)[-1].split("?")[0]).touch(exist_ok=False)
        return None if "gone" in url else b"\xff" if "bad" in url else f"page of {url}\f two".encode()

    def decode(content):
        return [x.strip() for x in content.decode().split("\f")]

    wanted = spark.createDataFrame([("http://a/x.pdf",), ("http://b/x.pdf?z",), ("http://b/bad.pdf",), ("http://b/gone.pdf",), (None,)], "pdf_url string")
    got = {r.pdf_url: r for r in web.stored_files(path, wanted, fetch, decode).collect()}
    assert got["http://a/x.pdf"].pdf_text == got["http://b/x.pdf?z"].pdf_text and got["http://a/x.pdf"].pdf_text.endswith("two")
    assert got["http://b/bad.pdf"].pdf_text is None and got["http://b/bad.pdf"].content and got["http://b/gone.pdf"].content is None and len(got) == 5
    (log / "gone.pdf").unlink()  # what is stored is not fetched again; what failed is
    again = {r.pdf_url: r for r in web.stored_files(path, wanted, fetch, decode).collect()}
    assert again == got and (log / "gone.pdf").exists()


def test_pages_with_images(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"one\fTwo")
    pages = readers.read_pages(spark, str(tmp_path / "p.pdf"), lambda b: [(x, k + 1) for k, x in enumerate(b.decode().split("\f"))])
    stats = extract.document_stats(pages, "n_images").first()
    assert (stats.total_pages, stats.total_images) == (2, 3)


def test_interpret_contract(spark):
    replies = spark.createDataFrame([("d", 0, 0, 0, "Prudential", None, "MAINTAIN", None, "Reporting", "Mandatory", "0.4"), ("d", 0, 0, 1, "None such", "c", " MAINTAIN", "o", None, "Maybe", "x")], interpret.REPLY)
    r = interpret.coerce(replies, ["Prudential"]).first()
    assert (r.domain, r.action, r.obligation_type, r.mandatory_flag, r.confidence_score, r.concept) == ("Other", "OTHER", "Other", "Not Applicable", None, "c")
    nodes = structure.build_structure(_lines(spark, MARKDOWN))
    plain = interpret.tag_units(nodes, [])
    assert plain.filter("is_operative").count() == 5 and plain.filter("action IS NOT NULL").count() == 0
    failed = interpret.tag_units(nodes, [], lambda units: 1 / 0, size=2)
    assert interpret.tag_counts(failed).first().unclassified == 5


def test_hooks():
    waits = []
    flaky = iter(["", "yes"])
    ask = hooks.first_answer([("a", lambda m: 1 / 0), ("b", lambda m: next(flaky))], sleep=waits.append)
    assert ask([]) == "yes" and waits == [2.0, 2.0]
    with pytest.raises(RuntimeError, match="all providers failed"):
        hooks.first_answer([("a", lambda m: " ")], sleep=waits.append)([])
    with pytest.raises(ValueError):
        hooks.first_answer([])
    assert hooks.probe([("ok", lambda m: "x"), ("bad", lambda m: 1 / 0)])["ok"] == "ok"
    turns = iter([{"role": "assistant", "tool_calls": [{"id": "1", "name": "add", "arguments": {"a": 1, "b": 2}}]}, {"role": "assistant", "content": "3"}])
    assert [m["role"] for m in hooks.chat(lambda h: next(turns), {"add": lambda a, b: a + b}, [{"role": "user", "content": "?"}])] == ["user", "assistant", "tool", "assistant"]
    assert hooks.hashed_embedder(["a b"]) == hooks.hashed_embedder(["a b"], True)
