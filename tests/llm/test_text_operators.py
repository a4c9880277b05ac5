"""Quality, language, pieces, leaks, counts, shards and URLs against plain versions and on odd inputs."""

from __future__ import annotations

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemill.llm.decontaminate import HammingIndex, ItemIndex, drop_contaminated, find_items
from clausemill.llm.language_id import UNKNOWN, predict, sample_rows, train
from clausemill.llm.lattice import Lattice, Vocabulary
from clausemill.llm.quality_rules import bucket, bucket_top, keep_good, quality_report
from clausemill.llm.sentencepiece_codec import MODEL, _seeds, decode, encode, encode_batch
from clausemill.llm.sharding import fill, place
from clausemill.llm.token_counts import TokenRollup, count_tokens
from clausemill.llm.url_filters import host_of, judge_urls, path_of

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here"), (5, "same words here"), (6, "a " * 200), (None, "null id text " * 30), (7, "Ünïcode ☃ \x00 text\u2028mark\u00a0joined ▁ under"), (8, "x" * 3000)]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.from_model(MODEL)


def _prose(rnd: random.Random, n: int, vocab: list[str]) -> str:
    return " ".join(rnd.choice(vocab) for _ in range(n))


def test_quality_measures_like_brute_force(make):
    rnd = random.Random(4)
    rows = [*ODD, *[(100 + k, "\n".join(_prose(rnd, rnd.randint(0, 12), [f"v{j}" for j in range(rnd.choice([3, 500]))]) for _ in range(6)) + rnd.choice(["", " ### $$ |", "\n\n"])) for k in range(60)]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in quality_report(make(rows)).drop("kept").collect()), key=key)
    assert got == sorted(((k, *brute.measures(t)) for k, t in rows), key=key)
    assert quality_report(make(rows).limit(0)).count() == 0


def test_quality_query_like_brute_force(spark, sf):
    """kept of every document of the table, by its id; and each group has fences of its own."""
    from clausemill.llm import queries as q

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept, fences = brute.quality([(r.text, r.lang, r.source) for r in docs])
    assert {r.doc_id: r.kept for r in q.op10_quality_rules(spark, sf).collect()} == {r.doc_id: k for r, k in zip(docs, kept, strict=True)}
    assert 0 < sum(kept) < len(kept) and len({f[0] for f in fences}) > 1


def test_quality_cutoffs_follow_each_source(spark):
    """What is usual in one source is rejected in the other, in symbols and repeats; a source whose values run on has no cutoff."""
    rnd = random.Random(2)
    vocab = [f"word{k}" for k in range(900)]
    rows = []
    for k in range(120):
        plain, marked, again = (_prose(rnd, 100, vocab).split() for _ in range(3))
        dense = [f"{w}##" if j % 4 == 0 else w for j, w in enumerate(marked)]
        rows += [(f"{' '.join(plain)}", "en", "news"), (" ".join(dense), "en", "code"), (" ".join([*again, *again[: rnd.choice([0, 0, 5, 6, 7, 8, 9])]]), "en", "verse")]
        if k < 4:
            rows += [(" ".join(dense), "en", "news"), (" ".join([*plain, *plain[:9]]), "en", "news")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want, fences = brute.quality(rows)
    got = {r.doc_id: r.kept for r in quality_report(docs).collect()}
    assert [got[k] for k in range(len(rows))] == want
    gone = [r for r, k in zip(rows, want, strict=True) if not k]
    assert len(gone) == 8 and {s for _, _, s in gone} == {"news"}
    assert len({f[1] for f in fences}) == 2 and len({f[3] for f in fences}) == 2


def test_quality_fences_adapt_and_keep_clean(make):
    rnd = random.Random(1)
    vocab = ["the", "report", "of", "and", "to", "was", "in", "that", *[f"word{k}" for k in range(900)]]
    clean = [(k, _prose(rnd, rnd.randint(30, 200), vocab)) for k in range(300)]
    junk = [(1000 + k, " ".join(f"{w}%%% ###" for w in _prose(rnd, 60, vocab).split())) for k in range(10)]
    out = {r.doc_id: r.kept for r in quality_report(make(clean + junk)).collect()}
    assert all(out[k] for k, _ in clean) and not any(out[k] for k, _ in junk)
    docs = make(clean + junk)
    good = keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {k for k, _ in clean}


def test_buckets_hold_their_values(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**9]
    df = spark.createDataFrame([(x,) for x in values], "v long")
    for r in df.select("v", bucket_top(bucket(F.col("v"))).alias("top"), bucket(F.col("v")).alias("b")).collect():
        assert r.v <= r.top <= r.v * 33 / 32 + 1


def test_forward_sums_all_segmentations(vocabulary):
    log_p = vocabulary.zipf()
    probability = {x.replace("▁", " "): math.exp(log_p[k]) for k, x in enumerate(vocabulary.pieces) if x}
    for text in (" the", " hello", " Übung", " abcab", "☃☃", " "):
        lattice = Lattice(vocabulary, [text])
        assert lattice.forward(log_p)[lattice.last[0]] == pytest.approx(brute.path_probability(text, probability, math.exp(log_p[-1])))


def test_samples_follow_the_posterior(vocabulary):
    log_p = vocabulary.zipf()
    n = 20000
    ids = encode_batch(vocabulary, log_p, pa.array([" hello"] * n), np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lattice = Lattice(vocabulary, [" hello"])
    total = lattice.forward(log_p)[lattice.last[0]]
    for path, times in Counter(map(tuple, ids.to_pylist())).most_common(4):
        assert times / n == pytest.approx(math.exp(sum(log_p[k] for k in path) - total), abs=0.015)


def test_expected_counts_are_the_posterior(vocabulary):
    """Edge by edge, against all paths."""
    log_p = vocabulary.zipf()
    texts = [" hello", " abcab", " ☃a", " Übung"]
    lattice = Lattice(vocabulary, texts)
    expected = lattice.expected(log_p)
    for s, text in enumerate(texts):
        mine = np.flatnonzero((lattice.start >= lattice.base[s]) & (lattice.end <= lattice.last[s]))
        paths, done = [([], 0)], []
        while paths:
            path, at = paths.pop()
            if at == len(text):
                done.append((path, math.exp(sum(log_p[lattice.piece[e]] for e in path))))
            paths += [([*path, e], int(lattice.end[e] - lattice.base[s])) for e in mine if lattice.start[e] - lattice.base[s] == at]
        total = sum(p for _, p in done)
        for e in mine:
            assert expected[e] == pytest.approx(sum(p for path, p in done if e in path) / total)


def test_thresholds_do_not_depend_on_other_strings(vocabulary):
    log_p = vocabulary.zipf()
    rnd = random.Random(12)
    strings = [" " + "".join(rnd.choice("abcdefghistnreäß") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    upto, _ = Lattice(vocabulary, strings).backward_tables(log_p)
    alone = [Lattice(vocabulary, [x]).backward_tables(log_p)[0] for x in strings]
    assert np.array_equal(upto, np.concatenate(alone))


def test_pieces_do_not_depend_on_batches(spark, sf):
    from clausemill.llm import queries as q

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    vocabulary = Vocabulary.from_model(MODEL)
    log_p = vocabulary.zipf()
    alone = {k: encode_batch(vocabulary, log_p, pa.array([t]), _seeds(pa.array([k]), 0)).to_pylist()[0] for k, t in rows}
    got = {r.doc_id: r for r in encode(docs).collect()}
    assert {k: r.token_ids for k, r in got.items()} == alone
    spelled = [b"" if x is None else x.replace("▁", " ").encode() for x in vocabulary.pieces]
    for value, number in enumerate(vocabulary.byte_ids.tolist()):
        spelled[number] = bytes([value])
    assert {k: b"".join(spelled[i] for i in ids).decode() for k, ids in alone.items()} == dict(rows)
    assert {(r.doc_id, r.n_pieces, r.lossless) for r in q.op3_sentencepiece(spark, sf).collect()} == {(k, len(ids), True) for k, ids in alone.items()}


def test_pieces_like_brute_force(make, spark, sf, vocabulary):
    """Ids of whole texts, drawn one character after another in plain Python; and the digest that the query makes of them."""
    from clausemill.llm import queries as q

    pieces = {x.replace("▁", " "): k for k, x in enumerate(vocabulary.pieces) if x}
    log_p, byte_ids = vocabulary.zipf().tolist(), vocabulary.byte_ids.tolist()
    odd = [r for r in ODD if r[0] is not None and r[1] is not None]
    got = {(r.doc_id, r.n_chars): r.token_ids for r in encode(make(odd)).collect()}
    assert got == {(k, len(t)): brute.sampled_pieces(t, k, pieces, log_p, byte_ids) for k, t in odd}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2000").collect()][:60]
    want = [(k, brute.sampled_pieces(t, k, pieces, log_p, byte_ids)) for k, t in docs]
    digest = F.lower(F.lpad(F.hex(F.xxhash64("ids")), 16, "0"))
    hashed = {r.k: (r.h, r.n) for r in spark.createDataFrame(want, "k long, ids array<int>").select("k", digest.alias("h"), F.size("ids").alias("n")).collect()}
    found = {r.doc_id: (r.ids_hash, r.n_pieces) for r in q.op3_sentencepiece(spark, sf).collect()}
    assert {k: found[k] for k in hashed} == hashed and len(hashed) == 60


def test_pieces_round_trip_and_repeat(make):
    docs = make(ODD)
    out = encode(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "kept", "n_pieces", "token_ids", "lossless"]
    back = decode(out).select("doc_id", "text")
    assert sorted(((r.doc_id or -1), r.text or "?") for r in back.collect()) == sorted(((k or -1), (t if t is not None else "?") or "?") for k, t in ODD)
    rows = {(r.doc_id, r.n_chars): r for r in out.collect()}
    assert rows[1, 0].token_ids is None and rows[2, 0].token_ids == []
    assert all(r.lossless for k, r in rows.items() if k[0] != 1)
    again = {(r.doc_id, r.n_chars): r.token_ids for r in encode(docs.repartition(1)).collect()}
    assert again == {k: r.token_ids for k, r in rows.items()}
    other = {(r.doc_id, r.n_chars): r.token_ids for r in encode(docs, seed=1).collect()}
    assert other != again
    assert encode(docs.limit(0)).count() == 0


def test_language_held_out(spark, make):
    rnd = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["und", "sch", "ung", "ein", "ß"], "es": ["ción", "que", "os", "ar", "ña"]}
    rows = [(k * 3 + j, lang, " ".join("".join(rnd.choice(p) for _ in range(rnd.randint(1, 3))) for _ in range(30))) for k in range(60) for j, (lang, p) in enumerate(parts.items())]
    docs = spark.createDataFrame(rows, "key long, lang string, text string")
    model = train(docs.filter("key % 4 <> 0"), train_rows=40)
    out = {r.key: r for r in predict(docs, model, "key").collect()}
    held = [(k, lang) for k, lang, _ in rows if k % 4 == 0]
    assert sum(out[k].lang_pred == lang for k, lang in held) / len(held) > 0.95
    assert all(0 < out[k].score <= 1 for k, _ in held)
    odd = {r.doc_id: r for r in predict(make([(1, None), (2, ""), (3, "12 .. ☃"), (4, "the" * 2000)]), model).collect()}
    assert [odd[k].lang_pred for k in (1, 2, 3)] == [UNKNOWN] * 3 and odd[1].score == 0 and odd[4].lang_pred == "en"
    nothing = predict(make([(1, "text")]), train(docs.limit(0))).first()
    assert nothing.lang_pred == UNKNOWN


def test_language_model_is_a_function_of_its_texts(spark, sf):
    """Batches, partitions, repeated rows and ids change nothing; and the model says what a plain one says."""
    from clausemill.llm import queries as q

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = train(docs, train_rows=30)
    try:
        spark.conf.set(key, "7")
        other = train(docs.union(docs).withColumn("doc_id", F.lit(None)).repartition(5), train_rows=30)
    finally:
        spark.conf.set(key, before)
    assert model.names == other.names and np.array_equal(model.log_p, other.log_p) and np.array_equal(model.prior, other.prior)
    found = q.op5_language_id(spark, sf).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    held = [r for r in found if r.held_out and rows[r.doc_id].lang]
    assert len(found) == len(rows) and sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.97
    vocabulary = model.vocabulary
    tables = [({x.replace("▁", " "): math.exp(model.log_p[k, j]) for k, x in enumerate(vocabulary.pieces) if x}, math.exp(model.log_p[-1, j])) for j in range(len(model.names))]
    for r in predict(docs.filter("doc_id < 20"), model).collect():
        words = [w.strip("0123456789.,;:!?()[]{}<>\"'`*#$%&|/\\+=~^_@-") for w in brute.words(rows[r.doc_id].text.lower())]
        cost = [model.prior[j] + sum(brute.path_probability(f" {w}", *tables[j]) for w in words if any(c.isalpha() for c in w)) for j in range(len(model.names))]
        assert r.lang_pred == model.names[int(np.argmax(cost))] and r.score == pytest.approx(1 / sum(math.exp(c - max(cost)) for c in cost))


def test_language_sample_counts_different_texts(spark):
    """200,000 copies of one text leave the sample, and so the model, as they are."""
    base = spark.range(3000).selectExpr("IF(id % 2 = 0, 'en', 'de') AS lang", "concat('text ', id, ' of words') AS text")
    hot = spark.range(200_000).selectExpr("'en' AS lang", "'text 0 of words' AS text")
    rows = lambda df: sorted(map(tuple, sample_rows(df, 1000).select("lang", "text").collect()))
    plain = rows(base)
    assert rows(base.union(hot)) == plain and len(plain) == 2000
    found = predict(base.limit(2).selectExpr("1 AS doc_id", "text", "lang"), train(base, 20), keep=[F.lit(1).alias("id"), F.lit(2).alias("text")])
    assert found.columns == ["doc_id", "id", "text", "lang_pred", "score"]


def test_leaks_like_brute_force(spark, make):
    rnd = random.Random(8)
    vocab = [f"t{k}" for k in range(300)]
    items = [(k, _prose(rnd, n, vocab)) for k, n in enumerate([3, 4, 5, 8, 15, 30, 30, 55])] + [(20, None), (21, ""), (22, _prose(random.Random(8), 3, vocab))]
    rows = list(ODD)
    for k in range(80):
        text = _prose(rnd, rnd.randint(0, 60), vocab).split()
        item = rnd.choice(items[:8])[1].split()
        for _ in range(rnd.choice([0, 0, 1, 3])):
            item[rnd.randrange(len(item))] = rnd.choice(vocab)
        cut = rnd.choice([0, 0, 1, 2])
        at = rnd.randint(0, len(text))
        rows.append((100 + k, " ".join(text[:at] + [w.upper() for w in item[cut:]] + text[at:]) if k % 4 else " ".join(item)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_items(make(rows), table).collect()}
    want = {(k, i): s for k, t in rows for i, s in brute.leaks(t, items).items()}
    assert got == pytest.approx(want) and len(want) > 30
    small = {(r.doc_id, r.item_id) for r in find_items(make(rows), table, block_bytes=40).collect()}
    assert small == set(want)
    left = drop_contaminated(make(rows), table)
    assert left.columns == make(rows).columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(k or -1 for k, t in rows if not brute.leaks(t, items))
    assert find_items(make(rows), table.limit(0)).count() == 0


def test_leaks_at_the_limit(spark, make):
    """Windows exactly 0.8 similar, some with a word again and again: all are found, far fingerprints too."""
    rnd = random.Random(4)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n + 4))) for k, n in enumerate([9, 18, 45, 90, 180] * 8)]
    rows = []
    for k, text in items:
        item = text.split()
        gone = (len(item) - 4) // 9
        for j, tail in enumerate([[f"o{rnd.random()}" for _ in range(gone)], ["again"] * gone]):
            rows.append((2 * k + j, " ".join([f"b{k}"] * 3 + item[: len(item) - gone] + tail)))
    want = {(k, i): s for k, t in rows for i, s in brute.leaks(t, items).items()}
    assert len(want) == len(rows) and set(want.values()) == {0.8}
    table = spark.createDataFrame(items, "item_id long, text string")
    found = find_items(make(rows), table).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(want)
    assert 30 < max(r.differing_bits for r in found) <= 79
    assert drop_contaminated(make(rows), table).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    """Random and planted fingerprints, few and many, against all distances; most others are not even looked at."""
    rng = np.random.default_rng(3)
    for n in (40, 6000):
        prints = rng.integers(0, 2**63, (n, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 4), dtype=np.uint64)
        queries = prints[rng.integers(0, n, 300)].copy()
        for q, flips in zip(queries, rng.integers(0, 100, 300), strict=True):
            bits = np.unpackbits(q.view(np.uint8))
            bits[rng.permutation(256)[:flips]] ^= 1
            q[:] = np.packbits(bits).view(np.uint64)
        bits = np.bitwise_count(queries[:, None] ^ prints).sum(axis=2, dtype=np.int64)
        for radius in (79, 40):
            index = HammingIndex(prints, radius)
            got = set(zip(*(x.tolist() for x in index.near(queries)), strict=True))
            assert got == {(int(q), int(j), int(bits[q, j])) for q, j in zip(*np.nonzero(bits <= radius), strict=True)} and len(got) > 50
    looked = np.unique(np.concatenate([index._block(queries.view(np.uint16)[:, k], *index.blocks[k]) for k in range(16)]), return_counts=True)[1]
    assert (looked >= 3).mean() < 0.5 and (looked >= 3).sum() < 0.3 * 300 * n
    with pytest.raises(ValueError):
        ItemIndex([(1, "a b")], 5, 80, 0.8)


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, version string, op string, n_tokens long, old_tokens long")
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    load = rows(("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None), ("b", "de", "v2", "insert", 7, None))
    assert rollup.commit("one", load) and not rollup.commit("one", load)
    assert rollup.commit("two", rows(("a", "en", "v1", "revise", 3, 10), ("b", "de", "v2", "delete", 7, None)))
    assert rollup.commit("empty", load.limit(0))
    want = {("a", "en", "v1", 2, 8), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want and rollup.batches() == ["empty", "one", "two"]
    assert not rollup.commit("two", load) and rollup.commit("three", rows(("a", "en", "v1", "insert", 1, None)))
    rollup.compact()
    assert ("a", "en", "v1", 3, 9) in {tuple(r) for r in rollup.totals().collect()} and len(rollup.batches()) == 4
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("bad", rows(("a", "en", "v1", "upsert", 1, None)))
    with pytest.raises(ValueError):
        rollup.commit("a/b", load)


def test_rollup_of_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits the same batch between looking and publishing: it counts once."""
    from clausemill.llm import token_counts

    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], "source string, lang string, version string, op string, n_tokens long, old_tokens long")
    publish, other = token_counts.publish, TokenRollup(spark, str(tmp_path / "r"))

    def late(*args):
        monkeypatch.setattr(token_counts, "publish", publish)
        assert other.commit("one", rows)
        return publish(*args)

    monkeypatch.setattr(token_counts, "publish", late)
    assert not TokenRollup(spark, str(tmp_path / "r")).commit("one", rows)
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_rollup_folded_by_two(spark, tmp_path, monkeypatch):
    """Another writer commits and folds while this one folds: what it folded counts once, and this one's folder goes."""
    from clausemill.llm import token_counts

    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], "source string, lang string, version string, op string, n_tokens long, old_tokens long")
    one, other = TokenRollup(spark, str(tmp_path / "r")), TokenRollup(spark, str(tmp_path / "r"))
    for k in range(3):
        one.commit(f"b{k}", rows)
    publish = token_counts.publish

    def late(*args):
        monkeypatch.setattr(token_counts, "publish", publish)
        assert other.commit("late", rows)
        other.compact()
        return publish(*args)

    monkeypatch.setattr(token_counts, "publish", late)
    one.compact()
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v1", 4, 40)]
    assert one.commit("after", rows) and not one.commit("late", rows)
    one.compact()
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v1", 5, 50)] and len(other._live()[0]) == 1


def test_token_counts(make):
    import base64

    import tiktoken

    from clausemill.llm.token_counts import PATTERN, RANKS

    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    got = sorted(r.n_0 for r in count_tokens(make(ODD), ["text"]).collect())
    assert got == sorted(len(plain.encode_ordinary(t)) if t else 0 for _, t in ODD)


def test_rollup_query_like_brute_force(spark, sf):
    from clausemill.llm import queries as q

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    import base64

    import tiktoken

    from clausemill.llm.token_counts import PATTERN, RANKS

    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    want: dict[tuple, list] = {}
    for d in docs:
        if d.doc_id not in toxic:
            n = len(plain.encode_ordinary("\n".join(dict.fromkeys(d.text.split("\n")))))
            have = want.setdefault((d.source, d.lang), [0, 0])
            have[0] += 1
            have[1] += n
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in q.op2_token_counts(spark, sf).collect()}
    assert got == want


def test_shards_take_turns(make):
    names = [f"s{k}" for k in range(7)]
    table = fill(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = fill(names[:-1], 1009)
    moved = sum(a != b and names[a] != "s6" for a, b in zip(table, fewer, strict=True))
    assert moved < 0.15 * 1009
    docs = make(ODD).withColumnRenamed("kept", "shard")
    out = place(docs, names, slots=1009)
    assert out.count() == len(ODD) and set(out.columns) == {*docs.columns, "slot"}
    assert all(r.shard == names[table[r.slot]] for r in out.collect())
    assert place(docs.limit(0), names, slots=1009).count() == 0
    odd = docs.selectExpr("doc_id AS __slot", "doc_id AS Shard", "doc_id AS at", "doc_id AS of", "doc_id AS owner", "text AS slot", "text AS `a.b`")
    for key in ("__slot", "Shard", "at"):
        got = place(odd, names, key, slots=1009)
        assert got.columns == ["__slot", "at", "of", "owner", "a.b", "slot", "shard"]
        assert sorted(str((r["__slot"], r.slot, r.shard)) for r in got.collect()) == sorted(str((r.doc_id, r.slot, r.shard)) for r in out.collect())
    for bad in ([], ["a", "a"], ["a,b"]):
        with pytest.raises(ValueError):
            fill(bad, 1009)
    with pytest.raises(ValueError):
        fill(names, 1008)


def test_url_parts(spark):
    urls = {None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Ex.COM": ("a.ex.com", ""), "https://h/p/q?x=://y/z#f": ("h", "/p/q"), "x://h?q/r": ("h", ""), "x://h#f": ("h", ""), "http:///only/path": ("", "/only/path"), "a\n://H\n/p": ("h\n", "/p"), "http://ÄB.de/Ü": ("Äb.de", "/Ü")}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    assert {r.url: (r.h, r.p) for r in df.collect()} == urls


def test_url_rules_and_templates(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/")]
    urls = ["http://a.com/x", "http://example.com/en/1", "http://www.example.com/en/1", "http://sub.example.com/en/", "http://notexample.com/en/", "http://com", "http://example.com/de/"]
    urls += [f"http://site.org/bad/{k}.html" for k in range(60)] + [f"http://site.org/good/{k}" for k in range(60)] + [None, "junk"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, k < 67) for k in range(7, 127, 2)] + [(7, None), (7, True)], "key long, bad boolean")
    out = {r.page_id: r for r in judge_urls(pages, rules, labels).collect()}
    assert [out[k].verdict for k in range(7)] == ["allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert [out[k].rule for k in (0, 1, 2, 5)] == ["com/", "example.com/en/", "www.example.com/en/", None]
    assert {(out[k].template, out[k].verdict) for k in range(7, 67)} == {("/bad/*.html", "block")}
    assert {(out[k].template, out[k].verdict) for k in range(67, 127)} == {("/good/*", "allow")}
    assert (out[127].host, out[127].path, out[127].rule, out[127].verdict) == ("", "", None, "allow")
    assert len(out) == len(urls) and judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages.filter("page_id >= 7"), [], None).collect()} == {"allow"}


def test_urls_that_differ_at_the_fifth_segment(spark):
    rows = [(2 * k + j, f"http://h.example/a/b/c/d/{name}/x{k % 3}.html") for k in range(30) for j, name in enumerate(("spam", "docs"))]
    labels = spark.createDataFrame([(k, k % 2 == 0) for k, _ in rows], "key long, bad boolean")
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()
    assert {r.page_id: r.verdict for r in got} == {k: "allow" if k % 2 else "block" for k, _ in rows}


def test_urls_alike_without_broadcast(spark, sf, monkeypatch):
    """Tables of branches beyond the bound are joined by shuffle: the same rows."""
    from clausemill.llm import queries as q
    from clausemill.llm import url_filters

    want = sorted(map(tuple, q.op8_url_filters(spark, sf).collect()))
    monkeypatch.setattr(url_filters, "BRANCH_BYTES", -1)
    assert sorted(map(tuple, q.op8_url_filters(spark, sf).collect())) == want


def test_url_templates_equal_sql_at_any_depth(spark):
    """Random trees with hubs, endings inside chains and wide levels, against the SQL that goes level by level."""
    import duckdb

    from clausemill.llm.url_filters import duckdb_sql

    rnd = random.Random(12)
    urls = []
    for k in range(900):
        depth = rnd.choice([0, 1, 2, 3, 3, 4, 6, 9])
        wide = [f"p{rnd.randrange(60)}.html"] if rnd.random() < 0.4 else []
        urls.append(f"http://h{rnd.randrange(3)}.org/" + "/".join([*(rnd.choice("aab") for _ in range(depth)), *wide]) + rnd.choice(["", "", "/", "?q=1"]))
    urls += ["http://h0.org/" + "/".join("deep" for _ in range(k)) for k in range(8)] + [None, "junk", "http://h9.org"]
    rows = list(enumerate(urls))
    bad = [(k, rnd.random() < (0.8 if "/b" in (u or "") else 0.1)) for k, u in rows if rnd.random() < 0.7]
    rules = [("block", "h1.org/a/a/"), ("allow", "org/b/")]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    con.sql("CREATE TABLE labels (key BIGINT, bad BOOLEAN)")
    con.executemany("INSERT INTO labels VALUES (?, ?)", bad)
    for children in (3, 16):
        want = con.sql(duckdb_sql(rules, "SELECT key, bad FROM labels", depth=12, max_children=children)).fetchall()
        got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, spark.createDataFrame(bad, "key long, bad boolean"), max_children=children).drop("purity").collect()
        key = lambda r: r[0]
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_deep_path_adds_no_rounds(spark, monkeypatch):
    from clausemill.llm import url_filters

    rounds = []
    grow = url_filters._grow
    monkeypatch.setattr(url_filters, "_grow", lambda *a: rounds.append(1) or grow(*a))
    urls = [f"http://a.org/{k % 7}/{k}" for k in range(60)]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "page_id long, url string")
    plain = {r.url: r.template for r in judge_urls(frame(urls), []).join(frame(urls), "page_id").collect()}
    few, deep = len(rounds), "http://b.org/" + "/".join(map(str, range(300)))
    found = judge_urls(frame([*urls, deep, "http://a.org/3/" + "x/" * 300]), []).join(frame([*urls, deep]), "page_id").collect()
    assert len(rounds) - few == few <= 2
    assert {r.url: r.template for r in found}[deep] == "/" + "/".join(map(str, range(300))) and len(plain) == 60
