"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from clausemill.llm.conversation_repair import damage, digests, repair

sys.setrecursionlimit(10_000)
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows, each edit tried at each place."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    marks, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(_WHITE)
        marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[2][:1] for r in rows]

    @lru_cache(None)
    def best(i, state):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for x, name in (("u", "user"), ("a", "assistant")):
            if (state, x) in _STEP and not (i == len(rows) and state in ("", "a")):
                rest = deeper(i, x)
                found += [(5 + c, "I" + s, ((name, ""), *t)) for c, s, t in rest]
        if i < len(rows):
            c, s, t = best(i + 1, state)
            found.append((2 + c, "D" + s, t))
            if marks[i] not in ("blank", "duplicate"):
                cut = 5 * (marks[i] == "truncated")
                for x, role, op, price in ((first[i], rows[i][2], "K", 0), ("u", "user", "R", 1), ("a", "assistant", "R", 1)):
                    if (op == "K" or x != first[i]) and (state, x) in _STEP:
                        c, s, t = best(i + 1, x)
                        found.append((price + cut + c, op + s, ((role, rows[i][3]), *t)))
        return min(found)

    def deeper(i, state):
        """After a turn is put in: rows go on, or one more is put in (a third is never cheaper)."""
        found = []
        if i == len(rows) and state == "a":
            found.append((0, "", ()))
        if state == "u":
            if i == len(rows):
                found.append((5, "I", (("assistant", ""),)))
        if i < len(rows):
            c, s, t = best(i + 1, state)
            found.append((2 + c, "D" + s, t))
            if marks[i] not in ("blank", "duplicate"):
                cut = 5 * (marks[i] == "truncated")
                for x, role, op, price in ((first[i], rows[i][2], "K", 0), ("u", "user", "R", 1), ("a", "assistant", "R", 1)):
                    if (op == "K" or x != first[i]) and (state, x) in _STEP:
                        c, s, t = best(i + 1, x)
                        found.append((price + cut + c, op + s, ((role, rows[i][3]), *t)))
        return found

    cost, audit, turns = best(0, "")
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    body = "\n".join(f"{r}:{t}" for r, t in turns)
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()


def _all_edits(first, marks):
    """Cheapest cost and least audit by writing out every sequence of edits with at most two turns put in at each place: for a few rows."""
    found = []
    places = [["", "u", "a", "ua", "au"]] * (len(first) + 1)
    moves = [["D"] + ([] if m in ("blank", "duplicate") else ["K", "u", "a"]) for m in marks]
    for put in itertools.product(*places):
        for ops in itertools.product(*moves):
            roles, audit, cost = put[0], "I" * len(put[0]), 5 * len(put[0])
            for f, m, op, more in zip(first, marks, ops, put[1:], strict=True):
                roles += "" if op == "D" else f if op == "K" else op
                audit += ("R" if op in "ua" else op) + "I" * len(more)
                cost += (2 if op == "D" else int(op in "ua") + 5 * (m == "truncated")) + 5 * len(more)
                roles += more
            rest = roles.removeprefix("s")
            if not roles or (rest and rest == "ua" * (len(rest) // 2)):
                found.append((cost, audit))
    return min(found)


def _got(repaired):
    report = {r["conv_id"]: r for r in repaired.report.collect()}
    told = {r["conv_id"]: r["repaired_sha256"] for r in digests(repaired).collect()}
    assert report.keys() == told.keys()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {k: (*(r[n] for n in names), told[k]) for k, r in report.items()}


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, part int").repartition(5)


def _random_rows(seed, convs, most):
    rng = random.Random(seed)
    words = ["Yes.", "no", " ", "", "Well? ", "a. b", "?!", " ", "so\n", None, "Yes.", "fine!\t\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + (turn > 4) * 3, rng.choice(roles), rng.choice(words)))
    return rows


def test_the_plain_search_is_right():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 3)
        rows = [(1, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", " ", "Yes."])) for k in range(n)]
        cost, audit = _plain(rows)[5:7]
        marks, seen = [], set()
        for _, _, role, text in rows:
            marks.append("blank" if text == " " else "duplicate" if (role, text) in seen else "truncated" if text == "no" else "")
            seen.add((role, text))
        assert (cost, audit) == _all_edits([r[2][0] for r in rows], marks)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_the_plain_search(spark, seed):
    rows = _random_rows(seed, 60, 12)
    got = _got(repair(damage(_frame(spark, rows)), times_col="times"))
    after = {}
    for r in rows:
        after.setdefault(r[0], [])
    for r in _damaged(rows):
        after[r[0]].append(r)
    assert got == {k: _plain(v) for k, v in after.items()}


def test_one_conversation_over_many_ranges(spark):
    """A conversation with most of the rows, exact copies in a third of them: pieces give what the whole gives."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", " ", f"Turn {k % 50}."])) for k in range(600)]
    rows += [(7, 300, "user", "Same.")] * 200 + [(8, 1, "user", "Hi."), (9, None, "user", "Hi.")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = repair(_frame(spark, rows))
        got = _got(repaired)
        assert repaired.pieces.filter("conv_id = 7").select("part").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {c: _plain([r for r in rows if r[0] == c]) for c in (7, 8, 9)}


def test_lost_conversations_empty_tables_and_long_texts(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    kept = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    got = _got(repair(damage(_frame(spark, [(lost, 0, "user", "Gone."), (kept, 0, "assistant", "word " * 300_000 + ".")])), times_col="times"))
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[kept][5:7] == (2, "D")
    assert _got(repair(_frame(spark, [(1, 1, "user", "Hi.")]).filter("turn > 5"))) == {}
