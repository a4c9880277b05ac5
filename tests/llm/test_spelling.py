"""Spelling variants against plain dictionaries of deletions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clausemill.llm.spelling import Trie, _matrix, near_words, variants


def _words(rows, damaged):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damaged and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def _near(words):
    """Words one edit apart: they share a pattern with one letter left out or open, or one is the other without a letter."""
    out, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "?" + w[k + 1 :]].add(w)
            less = w[:k] + w[k + 1 :]
            if less in words:
                out[w].add(less)
                out[less].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def _plain(rows, damaged=True):
    words = _words(rows, damaged)
    near = _near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def _corpus(seed, docs):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aaabbcéÿz") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abzà") + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((k, rng.choice([" ", ", ", "1", "ć"]).join(words)))
    return [*rows, (None, "abbaa abbaa abbaa Abbaa"), (5, None), (6, ""), (7, rows[3][1]), (7, rows[3][1])]


@pytest.mark.parametrize(("shard", "block"), [(1 << 18, 64 << 20), (7, 1500)])
def test_variants_equal_plain_dictionaries(make, shard, block):
    """Also with tries of seven words in blocks of one or two."""
    rows = _corpus(1, 150)
    got = variants(make(rows), damaged=True, shard_words=shard, block_bytes=block)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows_ = got.collect()
    assert {tuple(r) for r in rows_} == _plain(rows) and len(rows_) == len(_plain(rows)) > 100


def test_edits_of_equal_letters_are_made_once():
    words = sorted({"a" * k for k in range(1, 9)} | {"aab", "abb", "aabb", "ab", "ba", "ÿa", "ÿÿ"})
    trie = Trie.of(*_matrix(pa.array(words)))
    pairs = [(words[a], words[b]) for x, y in trie.near(*_matrix(pa.array(words))) for a, b in zip(x, y, strict=True)]
    near = _near(set(words))
    assert sorted(pairs) == sorted((w, x) for w in words for x in near[w])


def test_long_words_and_empty_tables(spark, make):
    long = "ab" * 20_000
    got = variants(make([(1, f"{long} {long} {long} {long}x {long}x {long}x {long}x {long}x {long}x")]))
    assert {(len(r["word"]), r["n_near"], len(r["root"])) for r in got.collect()} == {(40_000, 1, 40_001), (40_001, 1, 40_001)}
    assert variants(make([(1, "x")]).filter("doc_id > 1")).collect() == []
    with pytest.raises(ValueError, match="factor"):
        variants(make([(1, "x")]), factor=1)
    assert near_words(spark.createDataFrame([("abcde", 3)], "word string, n long")).collect() == []
    assert np.array_equal(_matrix(pa.array(["aÿ"]))[0], [[1, 90, 0]])
