"""Repair of conversations whose turns are lost, blank, repeated, cut short or out of order.

Faults.  Rows stand by turn (nulls first; ties by role, then text).  The first of these that fits is a row's fault: blank (no
character other than ASCII white space), duplicate (role and text stand earlier in the conversation), truncated (its last
such character is not one of `.!?`).

Repair.  The roles that stay must read `(s?(ua)+)?` by their first letters.  Kept rows cost 0, rows given the role user or
assistant 1, deleted rows 2 (blank and duplicate ones are always deleted), empty turns put in 5; a truncated row that is
not deleted costs 5 more.  The audit names the edits in order: K, R, D, I.  Of equally cheap ones the least by ASCII counts.

Method: dynamic programming over the rows that are retained, from the last to the first.  What lies between two retained
rows is deleted, so its price is a difference of prefix sums, and the best next row in each role is one running minimum for
that role.  The pair of roles says what is put in between.  Two audits of equal cost differ first where one deletes further
(D comes first), or puts a turn in (I), or keeps (K) rather than reroles (R), so ties are settled by place and never by
comparing strings.

On a cluster.  Equal rows become one row with a count before anything is shuffled.  Rows are dealt out by ranges of
(conversation, turn, role, beginning of the text), so a conversation with a third of all rows is split over many tasks.
Conversations that lie inside one range are repaired there, as a stream.  The first and the last of a range may go on in
its neighbours: their rows are pieces, one for each range.  A piece becomes a table of 16 prices, from each role it may be entered
after to each it may be left after; one sweep over a conversation's tables (a row for each piece) fixes the two roles of
every piece, and then pieces are repaired independently.  One task sees no more of a conversation than one range, but for the
audit, which is one value by contract (one character for each row), and the digest, which reads its pieces as a stream.

Defined cases: null roles and texts count as one space; a null id is one conversation; rows without a turn stand first and
play no part in gaps; repeated rows are duplicates; a conversation of which no row is left has zeros, an empty audit and no
turns; an empty table gives no rows; other columns play no part.  A long text is a row like any other.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import few, settle, small_batches
from clausemill.llm.words import slices

BEFORE, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = ("", "system", "user", "assistant")
_PUT_IN = {(BEFORE, SYSTEM): (), (BEFORE, USER): (), (BEFORE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
_AT_END = ((), (USER, ASSISTANT), (ASSISTANT,), ())
_NEXT = [[(t, len(put)) for (a, t), put in _PUT_IN.items() if a == s] for s in range(4)]
_DELETE, _REROLE, _INSERT, _CUT, _NEVER = 2, 1, 5, 5, 1 << 60
_ENDS = [_INSERT * len(x) for x in _AT_END]
_LEGAL = {"su", "ua", "au"}
_STATS = ("blank", "duplicate", "truncated", "illegal")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with `times` (how often each stands there) after faults by crc32 of `conv_id:turn` modulo 20.

    0 loses the row (times 0, so that its conversation stays), 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4 makes its role user.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(either("text"), ".!?", "")).otherwise(either("text"))
    return turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(either("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


@dataclass(slots=True)
class _Row:
    """Equal rows that stand together: gone if all must go, cut if the first is truncated, n how many they are."""

    role: str
    text: str
    n: int
    gone: bool
    cut: bool


class _Plan:
    """The cheapest repair of some rows, from each role they may be entered after; ends: what it costs to be left after each role."""

    def __init__(self, rows: list[_Row], ends: list[int]):
        self.rows, self.before = rows, array("q", [0])
        for row in rows:
            self.before.append(self.before[-1] + row.n)
        self.next = [array("q", bytes(8 * len(rows))) for _ in range(4)]
        least, where, kept = [_NEVER] * 4, [0] * 4, [0] * 4  # by role: running minimum of price + deletions up to there, its row, whether that is rerole
        n, total = len(rows), self.before[-1]

        def ahead(s: int, at: int) -> tuple[int, int]:
            """Price of all that follows row `at` - 1 if that one has role s, and what is retained next (row * 4 + role, or -1)."""
            gone = _DELETE * self.before[at]
            best = (_DELETE * total + ends[s] - gone, -n, 0, 0, -1)
            for t, puts in _NEXT[s]:
                if least[t] < _NEVER:
                    best = min(best, (least[t] - gone + _INSERT * puts, -where[t], -puts, kept[t], where[t] * 4 + t))
            return best[0], best[4]

        for at in range(n - 1, -1, -1):
            row = rows[at]
            if row.gone:
                continue
            extra = _DELETE * (row.n - 1) + (_CUT if row.cut else 0) + _DELETE * self.before[at]
            first, found = row.role[:1], []
            for t in (SYSTEM, USER, ASSISTANT):
                own = first == _NAMES[t][0]
                if not own and t == SYSTEM:
                    continue
                price, self.next[t][at] = ahead(t, at + 1)
                found.append((t, price + extra + (0 if own else _REROLE), 0 if own else 1))
            for t, price, rerole in found:
                if price < least[t]:
                    least[t], where[t], kept[t] = price, at, rerole
        self.enter = [ahead(s, 0) for s in range(4)]

    def follow(self, s: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
        """Audit, retained turns and the role they end with, entered after role s; last: what is missing at the end is put in."""
        audit, turns, at, go = [], [], 0, self.enter[s][1]
        while go >= 0:
            j, t = divmod(go, 4)
            row, puts = self.rows[j], _PUT_IN[s, t]
            own = row.role[:1] == _NAMES[t][0]
            audit.append("D" * (self.before[j] - self.before[at]) + "I" * len(puts) + ("K" if own else "R") + "D" * (row.n - 1))
            turns += [(_NAMES[x], "") for x in puts]
            turns.append((row.role if own else _NAMES[t], row.text))
            at, s, go = j + 1, t, self.next[t][j]
        audit.append("D" * (self.before[-1] - self.before[at]))
        if last:
            audit.append("I" * len(_AT_END[s]))
            turns += [(_NAMES[x], "") for x in _AT_END[s]]
        return "".join(audit), turns, s


def _illegal(rows: list[_Row]) -> int:
    firsts = [r.role[:1] for r in rows]
    return sum(r.n - 1 for r in rows) + sum(a + b not in _LEGAL for a, b in zip(firsts, firsts[1:], strict=False))


def _faults(lines: list[tuple], seen: set | None) -> tuple[list[_Row], dict[str, int]]:
    """Rows and counts of faults from (turn, role, text, n, blank, cut, earlier); seen finds what stands earlier where the lines don't say."""
    rows, stats = [], dict.fromkeys(_STATS, 0)
    for _, role, text, n, blank, cut, earlier in lines:
        if seen is not None:
            earlier = (role, text) in seen
            seen.add((role, text))
        if blank:
            stats["blank"] += n
        else:
            stats["duplicate"] += n if earlier else n - 1
            stats["truncated"] += int(cut and not earlier)
        rows.append(_Row(role, text, n, bool(blank or earlier), bool(cut)))
    stats["illegal"] = _illegal(rows)
    return rows, stats


def _turn_list(turns: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for x in turns:
        ends.append(ends[-1] + len(x))
    flat = [y for x in turns for y in x]
    fields = [pa.array([y[k] for y in flat], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["role", "text"]))


_LINE = "part int, k long, turn long, role string, text string, n long, is_blank boolean, is_cut boolean"
_TURNS = "turns array<struct<role: string, text: string>>"
_DONE = f"gaps long, {', '.join(f'{c} long' for c in _STATS)}, cost long, audit string, {_TURNS}"


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


class _Out:
    """Rows of the first pass: open lines, and whole conversations."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.open, self.done, self.size = kind, [], [], 0

    def line(self, conv: object, part: int, k: int, line: tuple) -> None:
        self.open.append((conv, part, k, *line[:6]))
        self.size += len(line[2]) + 64

    def whole(self, conv: object, lines: list[tuple]) -> None:
        lines = [x for x in lines if x[3]]
        rows, stats = _faults(lines, set())
        plan = _Plan(rows, _ENDS)
        audit, turns, _ = plan.follow(BEFORE, True)
        self.done.append((conv, _gaps([x[0] for x in lines if x[0] is not None]), *(stats[c] for c in _STATS), plan.enter[BEFORE][0], audit, turns))
        self.size += sum(len(x[1]) for x in turns) + 64 * len(turns) + 64

    def batch(self) -> pa.RecordBatch:
        a, b = len(self.open), len(self.done)
        col = lambda rows, k, kind, lead, tail: pa.array([None] * lead + [x[k] for x in rows] + [None] * tail, kind)
        out = {"conv_id": pa.array([x[0] for x in self.open] + [x[0] for x in self.done], self.kind)}
        for k, (name, kind) in enumerate((("part", pa.int32()), ("k", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("is_blank", pa.bool_()), ("is_cut", pa.bool_())), 1):
            out[name] = col(self.open, k, kind, 0, b)
        for k, name in enumerate(("gaps", *_STATS, "cost"), 1):
            out[name] = col(self.done, k, pa.int64(), a, 0)
        out["audit"] = col(self.done, 7, pa.string(), a, 0)
        out["turns"] = _turn_list([[]] * a + [x[8] for x in self.done])
        self.open, self.done, self.size = [], [], 0
        return pa.RecordBatch.from_pydict(out)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range -> its inner conversations repaired, the rows of the first and of the last as they are."""
    part, now, held, first, k, out = TaskContext.get().partitionId(), object(), [], True, 0, None
    for batch in slices(batches, "text"):
        out = out or _Out(batch.column("conv_id").type)
        for conv, *line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "is_blank", "is_cut")), strict=True):
            if conv != now or k == 0:
                if held:
                    out.whole(now, held)
                first, now, held = k == 0, conv, []
            if first:
                out.line(conv, part, k, (*line, None))
            else:
                held.append((*line, None))
            k += 1
            if out.size > 1 << 21:
                yield out.batch()
    if held:
        for j, line in enumerate(held):
            out.line(now, part, k + j, line)
    if out is not None:
        yield out.batch()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[tuple]]]:
    """(conversation, part, lines) from rows sorted by them: one piece is held at a time."""
    now, held = None, []
    for batch in slices(batches, "text"):
        for conv, part, *line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "n", "is_blank", "is_cut", "earlier", "enter", "leave", "last")), strict=True):
            if now != (conv, part) and held:
                yield *now, held
                held = []
            now = conv, part
            held.append(tuple(line))
    if held:
        yield *now, held


_PRICE = f"part int, {', '.join(f'{c} long' for c in _STATS)}, head string, tail string, low long, high long, turns_seen long, first_turn long, last_turn long, n long, prices array<long>, ranks array<int>"


def _price(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each piece: counts, its edges, and from each role to each role the price and, for one role, the order of the audits."""
    for conv, part, lines in _pieces(batches):
        lines = [x for x in lines if x[3]]
        rows, stats = _faults([x[:7] for x in lines], None)
        turns = [x[0] for x in lines if x[0] is not None]
        prices, ranks, audits = [[_NEVER] * 4 for _ in range(4)], [], []
        for leave in range(4):
            plan = _Plan(rows, [0 if s == leave else _NEVER for s in range(4)])
            for s in range(4):
                prices[s][leave] = min(plan.enter[s][0], _NEVER)
            audits.append([plan.follow(s, False)[0] if plan.enter[s][0] < _NEVER else "~" for s in range(4)])
        for s in range(4):
            order = sorted(range(4), key=lambda e: audits[e][s])  # noqa: B023
            ranks += [order.index(e) for e in range(4)]
        row = {"conv_id": conv, "part": part, **stats, "head": rows[0].role[:1] if rows else None, "tail": rows[-1].role[:1] if rows else None, "low": min(turns, default=None), "high": max(turns, default=None), "turns_seen": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n": len(rows), "prices": [x for p in prices for x in p], "ranks": ranks}
        kinds = [kind, pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


_SWEPT = f"part int, enter int, leave int, last boolean, gaps long, {', '.join(f'{c} long' for c in _STATS)}, cost long"


def _sweep(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Tables of a conversation's pieces, in order -> the roles at the ends of each piece; the counts go with the last."""

    def solved(pieces: list[dict]) -> pa.RecordBatch:
        value, go = list(_ENDS), []
        for x in reversed(pieces):
            chosen = [min((min(x["prices"][4 * s + e] + value[e], _NEVER), x["ranks"][4 * s + e], e) for e in range(4)) for s in range(4)]
            go.append([c[2] for c in chosen])
            value = [c[0] for c in chosen]
        rows, s = [], BEFORE
        full = [x for x in pieces if x["n"]]
        stats = [sum(x[c] for x in pieces) for c in _STATS]
        stats[3] += sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(full, full[1:], strict=False))
        timed = [x for x in full if x["turns_seen"]]
        seen = sum(x["turns_seen"] for x in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
        gaps = max(x["high"] for x in timed) - min(x["low"] for x in timed) + 1 - seen if timed else 0
        for k, x in enumerate(pieces):
            e = go[len(pieces) - 1 - k][s]
            last = k == len(pieces) - 1
            rows.append((x["conv_id"], x["part"], s, e, last, *((gaps, *stats, value[BEFORE]) if last else (None,) * 6)))
            s = e
        kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]
        names = ["conv_id", "part", "enter", "leave", "last", "gaps", *_STATS, "cost"]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and held[-1]["conv_id"] != x["conv_id"]:
                yield solved(held)
                held = []
            held.append(x)
    if held:
        yield solved(held)


def _mend(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Audit and turns of each piece between the roles it was given."""
    for conv, part, lines in _pieces(batches):
        enter, leave, last = lines[0][7:10]
        rows, _ = _faults([x[:7] for x in lines if x[3]], None)
        audit, turns, _ = _Plan(rows, [0 if s == leave else _NEVER for s in range(4)]).follow(enter, last)
        for at in range(0, max(len(turns), 1), 1000):
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array(["" if at else audit]), _turn_list([turns[at : at + 1000]])], names=["conv_id", "part", "k", "audit", "turns"])


@dataclass
class Repaired:
    """report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  pieces: conv_id, part, k, whole, turns (role, text), in order of part and k."""

    report: DataFrame
    pieces: DataFrame


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None, most: int = 2_000_000) -> Repaired:
    """Every conversation repaired.  times_col: how often a row stands there (0: it is lost, and only its conversation counts); once if None."""
    spark = turns.sparkSession
    small_batches(spark)
    named = lambda c: F.col(f"`{c}`")
    space, times = F.lit(" "), F.lit(1) if times_col is None else named(times_col)
    base = turns.select(named(conv_col).alias("conv_id"), named(turn_col).cast("long").alias("turn"), F.coalesce(named(role_col), space).alias("role"), F.coalesce(named(text_col), space).alias("text"), times.cast("long").alias("n"))
    counted = base.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ranges = counted.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    seen = ranges.withColumns({"is_blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "is_cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    conv = f"conv_id {turns.schema[conv_col].dataType.simpleString()}"
    kind = _arrow_type(turns, conv_col)
    first = settle(seen.mapInArrow(_split, f"{conv}, {_LINE}, {_DONE}"), "ranges", even=False)
    done, lines = first.filter("part IS NULL"), first.filter("part IS NOT NULL").select("conv_id", "part", "k", "turn", "role", "text", "n", "is_blank", "is_cut")

    lines = lines.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    key = ["conv_id", "role", "h1", "h2"]
    earliest = lines.filter("n > 0").groupBy(*key).agg(F.min(F.struct("part", "k")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    earliest = few(settle(earliest.select(*(F.col(c).alias(f"_{c}") for c in key), "first"), "repeats"), most)
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    lines = lines.join(earliest, same, "left").withColumn("earlier", F.coalesce(F.struct("part", "k") > F.col("first"), F.lit(False))).drop(*(f"_{c}" for c in key), "first", "h1", "h2")
    lines = settle(lines, "pieces", even=False)
    ends = {"enter": F.lit(None).cast("int"), "leave": F.lit(None).cast("int"), "last": F.lit(None).cast("boolean")}
    by_piece = lambda df: df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "k")
    prices = settle(by_piece(lines.withColumns(ends)).mapInArrow(lambda it: _price(it, kind), f"{conv}, {_PRICE}"), "prices")
    swept = settle(prices.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda it: _sweep(it, kind), f"{conv}, {_SWEPT}"), "swept")
    roles = few(swept.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "enter", "leave", "last"), most)
    mended = lines.join(roles, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    mended = settle(by_piece(mended).mapInArrow(lambda it: _mend(it, kind), f"{conv}, part int, k long, audit string, {_TURNS}"), "mended", even=False)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "audit"))), lambda x: x["audit"])
    audits = mended.filter("k = 0").groupBy(F.col("conv_id").alias("_conv")).agg(F.array_join(parts, "").alias("audit"))
    columns = ["gaps", *_STATS, "cost", "audit"]
    report = done.select("conv_id", *columns).unionByName(swept.filter("last").join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", *columns))
    pieces = done.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("whole"), "turns").unionByName(mended.select("conv_id", "part", "k", F.lit(False).alias("whole"), "turns"))
    return Repaired(report.withColumnRenamed("conv_id", conv_col), pieces.withColumnRenamed("conv_id", conv_col))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _digest(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each conversation of pieces that come in order; nothing is held but the hash."""
    now, have, hashed, begun, last = None, False, hashlib.sha256(), False, kind

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if have and conv != now:
                yield told()
                hashed, begun = hashlib.sha256(), False
            now, have = conv, True
            if body is not None:
                hashed.update((("\n" if begun else "") + body).encode())
                begun = True
    if have:
        yield told()


def digests(repaired: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, repaired_sha256: of the repaired turns as `role:text`, joined by newlines."""
    body = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    pieces = repaired.pieces.withColumnRenamed(conv_col, "conv_id").select("conv_id", "part", "k", "whole", F.when(F.size("turns") > 0, body).alias("body"))
    kind = _arrow_type(pieces, "conv_id")
    split = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").select("conv_id", "body")
    told = split.mapInArrow(lambda it: _digest(it, kind), f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    return pieces.filter("whole").select("conv_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256")).unionByName(told).withColumnRenamed("conv_id", conv_col)
