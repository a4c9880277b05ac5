"""Near copies by whole shingle sets against a brute-force Jaccard."""

from __future__ import annotations

import random

import brute
import pytest

from clausemill.llm.near_texts import keep_one_text, near_texts


def _rows() -> list[tuple]:
    rnd = random.Random(6)
    vocab = [f"v{k}" for k in range(3000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    texts = []
    for n in (3, 9, 30, 100, 200, 500):
        for _ in range(4):
            base = prose(n)
            texts.append(base)
            for changed in (1, 2, 4, n // 30 + 1):
                other = list(base)
                for _ in range(changed):
                    other[rnd.randrange(n)] = rnd.choice(vocab)
                texts.append(other)
    crowd, common = prose(60), prose(8)
    texts += [crowd[:cut] + prose(60 - cut) for cut in range(46, 61) for _ in range(5)]  # many at and around the limit
    texts += [common + prose(24) for _ in range(70)]  # many with a common opening, unlike otherwise
    texts += [[], [], ["One"], ["one"]]
    rnd.shuffle(texts)
    return [(k, " ".join(t) or None) for k, t in enumerate(texts)]


def test_near_texts_like_brute_force(make):
    rows = _rows()
    want = brute.similar_groups(rows)
    assert {r.doc_id: r.component_id for r in near_texts(make(rows)).collect()} == want
    kept = keep_one_text(make([*rows, (None, rows[0][1])]))
    assert kept.columns == make(rows).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *sorted(k for k, g in want.items() if k == g)]
    assert near_texts(make(rows).limit(0)).count() == 0


def test_stage_drops_near_copies_with_far_digests(spark, make):
    """One changed word of a hundred: most such copies have digests over two bits apart."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k in range(20):
        text = [f"d{k}w{j}" for j in range(100)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:50], "other", *text[51:]]))]
    assert sum((brute.fingerprint(a[1]) ^ brute.fingerprint(b[1])).bit_count() > 2 for a, b in zip(rows[::2], rows[1::2], strict=True)) > 10
    left = dict(pipeline.STAGES)["near duplicates"](spark, make(rows), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 40, 2))


def test_crowds_below_the_similarity(make):
    """5,000 texts of a common passage and few own words are 0.75 similar: nobody meets but the planted near copies."""
    rnd = random.Random(9)
    common = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join([*common, *(f"o{k}x{j}" for j in range(14))])) for k in range(5000)]
    for k in range(60):  # two of the own words differ: 0.8 and more
        words = rows[k * 7][1].split()
        words[-1], words[-2] = "other", f"new{k}"
        rows.append((5000 + k, " ".join(words)))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_texts(make(rows)).collect()}
    assert got == {k: (k - 5000) * 7 if k >= 5000 else k for k, _ in rows}
    sample = [r for r in rows if r[0] >= 4900 or r[0] < 150]
    assert brute.similar_groups(sample) == {r.doc_id: r.component_id for r in near_texts(make(sample)).collect()}


def test_meet_sends_crowds_on_as_they_come():
    """A key of many batches stays whole: all its members are sent, also those of a stretch with one root; small keys next to it are paired."""
    import numpy as np
    import pyarrow as pa

    from clausemill.llm.near_texts import _meet

    n = 250_000
    key = np.repeat([1, 2, 3], [3, n, 3])
    rows = {"key": key, "salt": np.zeros(n + 6, np.int64), "kind": np.arange(n + 6), "n": np.full(n + 6, 100), "pos": np.zeros(n + 6, np.int64), "root": np.where(np.arange(n + 6) < n // 2, 7, 8)}
    rows["root"][:3], rows["root"][-3:] = [1, 2, 3], [1, 2, 3]
    table = pa.table(rows)
    out = pa.Table.from_batches(list(_meet(iter(table.to_batches(10_000)), 0.8))).to_pydict()
    crowd = [u for k, u in zip(out["key"], out["u"], strict=True) if k == 2]
    assert sorted(crowd) == list(range(3, n + 3))
    small = {(u, v) for k, u, v in zip(out["key"], out["u"], out["v"], strict=True) if k is None and (u < 3 or v > n + 2)}
    assert small == {(1, 0), (2, 0), (2, 1), (n + 4, n + 3), (n + 5, n + 3), (n + 5, n + 4)}
