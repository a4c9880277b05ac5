"""Near copies by fingerprints on the grid, verified by the similarity of whole shingle sets, and an exact way for what the grid misses.

Words with A-Z lower-cased, sets of 5-word shingles (a text with fewer words is one shingle); two documents are linked if
their sets have a Jaccard similarity of `least` or more.  Of each connected group the smallest id stays.

1. Documents with equal sets are one node.
2. Nodes have 64-bit SimHashes.  Those that the grid of bit counts links (simhash_dedup: at most two bits) are compared with the
   least node of their group, set by set; those similar enough share a root from now on.
3. One or two in ten shingles may differ at 0.8, about ten bits, and no grid of 64 bits selects at that distance.  So nodes
   with different roots also meet at rare shingles: in any one order of all shingles, two sets of similarity s have a common
   shingle among their first n - ceil(s n) + 1.  The order is rare first, by counts over all nodes; a shingle that
   no other node has is in that order, but is not sent.  The order decides what this costs and not what it finds.
4. Nodes that meet are candidates if their sizes allow the similarity, and so do the shingles before it in either, which at
   the first common one the other lacks.  Where over `_CROWD` meet, they are first compared with the middle one and their
   next neighbours by size, and then go on as single rows.  A node's size and place say how large a partner may be, so
   those of a crowd that are not connected by the links found meet by ranges of size, a node with the partners in its own
   range; pairs whose 256 parity bits prove that more shingles differ than may are left out.  Texts that have a common passage
   below the similarity, and rarer words besides, have empty ranges and meet nobody.
5. Candidates are verified on the whole sets.

Frequent shingles are dealt out by shingle and a part of the nodes, `_SPLIT` at a time, so a shingle that a third of all texts
have is spread over tasks; no task holds more than a batch of them.  Shingles are counted in as many parts as keep one at `_PART` shingles.

Texts are read once for each step and not written; shingles are counted in packed arrays, sorted and added up in each task
before they are shuffled.

Defined cases: texts without words are copies of each other; null ids stay and never name a group unless it has no other id;
rows that repeat an id each count; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.components import components
from clausemill.llm.shared import few, fresh, partitions, settle, small_batches
from clausemill.llm.simhash_dedup import _together, near_links
from clausemill.llm.words import Words, majority, mix, runs, signed, slices

_U = np.uint64
_CROWD, _NEXT, _FREQUENT, _MOST_BITS, _HELD, _SPLIT, _PART, _RATIO = 48, 4, 500_000, 29, 1 << 20, 4096, 1 << 22, 1.05
_ODD = ("odd0", "odd1", "odd2", "odd3")


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, sorted and each once, one text after another; and how many each has."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    full, found = runs(hashes, width, 0xA0), []
    for first, n in zip(words.first.tolist(), words.counts.tolist(), strict=True):
        found.append(np.unique(full[first : first + n - width + 1]) if n >= width else runs(hashes[first : first + n], n, 0xA0 + n) if n else full[:0])
    return np.concatenate([*found, full[:0]]), np.array([len(x) for x in found], np.int64)


def _odd(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """256 bits a set, as four words: whether an odd number of its shingles falls on each.  Two sets differ in at least as many shingles as bits."""
    some, at = np.flatnonzero(sizes), (flat >> _U(40)) & _U(255)
    out = [np.zeros(len(sizes), _U) for _ in range(4)]
    for k in range(4):
        if len(some):
            own = np.where(at >> _U(6) == _U(k), _U(1) << (at & _U(63)), _U(0))
            out[k][some] = np.bitwise_xor.reduceat(own, (np.cumsum(sizes) - sizes)[some])
    return out


def _each(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [flat[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _kind(bodies: list[bytes]) -> np.ndarray:
    return signed(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in bodies), _U, len(bodies)))


def _kinds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        flat, sizes = _sets(batch.column("text"), width)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "mark": batch.column("mark"), "kind": _kind(_each(flat, sizes)), "n": sizes, "fp": signed(majority(flat, sizes)), **{f"odd{k}": signed(x) for k, x in enumerate(_odd(flat, sizes))}})


def _bodies(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        bodies = _each(*_sets(batch.column("text"), width))
        yield pa.RecordBatch.from_pydict({"kind": _kind(bodies), "body": pa.array(bodies, pa.binary())})


def _place(flat: np.ndarray, parts: int) -> np.ndarray:
    """A shingle's part in the upper half and 32 bits of it in the lower: what tells shingles apart where they are counted."""
    return ((flat >> _U(32)) * _U(parts) >> _U(32)) << _U(32) | (flat & _U(0xFFFFFFFF))


def _counts(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted shingles of some texts by part, with how many texts have each (255 at most)."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        placed, times = np.unique(_place(np.concatenate(held), parts), return_counts=True)
        held.clear()
        cuts = np.searchsorted(placed, np.arange(parts + 1, dtype=_U) << _U(32))
        low, times = (placed & _U(0xFFFFFFFF)).astype(np.uint32), np.minimum(times, 255).astype(np.uint8)
        some = np.flatnonzero(np.diff(cuts))
        pick = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())
        yield pa.RecordBatch.from_pydict({"part": some.astype(np.int32), "keys": pick(low), "times": pick(times)})

    for batch in slices(batches, "text"):
        held.append(_sets(batch.column("text"), width)[0])
        if sum(map(len, held)) > _HELD:
            yield from flush()
    if held:
        yield from flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, the shingles that several nodes have, with their counts; and how many have each count."""
    held: dict[int, list] = {}
    for batch in batches:
        for x in batch.to_pylist():
            held.setdefault(x["part"], []).append((np.frombuffer(x["keys"], np.uint32), np.frombuffer(x["times"], np.uint8)))
    for part in list(held):
        keys, times = (np.concatenate(x) for x in zip(*held.pop(part), strict=True))
        order = np.argsort(keys, kind="stable")
        keys, lead = keys[order], np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        total = np.minimum(np.add.reduceat(times[order], lead, dtype=np.int64), 0x7FFFFFFF)
        keys, total = keys[lead][total > 1], total[total > 1]
        if len(keys):
            seen, n = np.unique(total, return_counts=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([keys.tobytes()]), "times": pa.array([total.astype(np.uint32).tobytes()]), "hist": pa.array([list(zip(seen.tolist(), n.tolist(), strict=True))], pa.map_(pa.int32(), pa.int64()))})


def _tables(batches: Iterator[pa.RecordBatch], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of each part, a bitmap of the shingles several nodes have, and those that at least `least` have."""
    for batch in batches:
        for x in batch.to_pylist():
            keys, times = np.frombuffer(x["keys"], np.uint32), np.frombuffer(x["times"], np.uint32)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[keys >> np.uint32(32 - bits)] = True
            many = times >= least
            yield pa.RecordBatch.from_pydict({"part": pa.array([x["part"]], pa.int32()), "bitmap": pa.array([np.packbits(bitmap, bitorder="little").tobytes()]), "keys": pa.array([keys[many].tobytes()]), "times": pa.array([times[many].tobytes()])})


def _often(texts: DataFrame, width: int, shingles: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Parts, bits of a part's bitmap, the bitmaps (2^29 bits at most in all), the most frequent shingles and their counts."""
    spark = texts.sparkSession
    parts = max(partitions(spark), -(-shingles // _PART))
    packed = texts.select("text").mapInArrow(lambda it: _counts(it, width, parts), "part int, keys binary, times binary").repartition(parts, "part")
    counted = settle(packed.mapInArrow(_repeated, "part int, keys binary, times binary, hist map<int,long>"), "counted", even=False)
    sizes = sorted((x[0], x[1]) for x in counted.select(F.explode("hist").alias("count", "n")).groupBy("count").agg(F.sum("n")).collect())
    left, least = sum(n for _, n in sizes), 2
    bits = min(max((16 * left // parts).bit_length(), 10), _MOST_BITS - (parts - 1).bit_length(), 32)
    for times, n in sizes:
        if left > _FREQUENT:
            left, least = left - n, times + 1
    bitmaps, keys, times = np.zeros((parts, (1 << bits) >> 3), np.uint8), [np.empty(0, _U)], [np.empty(0, np.int64)]
    for x in counted.select("part", "keys", "times").mapInArrow(lambda it: _tables(it, bits, least), "part int, bitmap binary, keys binary, times binary").collect():
        bitmaps[x["part"]] = np.frombuffer(x["bitmap"], np.uint8)
        keys.append(np.frombuffer(x["keys"], np.uint32).astype(_U) | _U(x["part"]) << _U(32))
        times.append(np.frombuffer(x["times"], np.uint32).astype(np.int64))
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys)
    return parts, bits, bitmaps, keys[order], times[order]


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, often, least: float) -> Iterator[pa.RecordBatch]:
    parts, bits, bitmaps, keys, times = often.value
    for batch in slices(batches, "text"):
        flat, sizes = _sets(batch.column("text"), width)
        kind = _kind(_each(flat, sizes))
        owner, placed = np.repeat(np.arange(len(sizes)), sizes), _place(flat, parts)
        cell = (placed & _U(0xFFFFFFFF)) >> _U(32 - bits)
        many = ((bitmaps[placed >> _U(32), cell >> _U(3)] >> (cell & _U(7)).astype(np.uint8)) & 1).astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, placed), len(keys) - 1)
            many = np.where(keys[at] == placed, times[at], many)
        order = np.lexsort((flat, many, owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pick = (rank < (sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1)[owner]) & (many[order] > 0)
        who, times_ = owner[pick], many[order][pick]
        salt = np.where(times_ > _SPLIT, (mix(kind[who].view(_U), 0x5A17) % (times_ // _SPLIT + 1).astype(_U)).astype(np.int64) + 1, 0)
        yield pa.RecordBatch.from_pydict({"key": signed(flat[order][pick]), "salt": salt, "kind": kind[who], "n": sizes[who], "pos": rank[pick]})


def _meet(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, salt, size and kind -> candidates with different roots (key null), and the members of crowded keys (v their size).

    A batch's last key is carried on, but for one that is crowded already: that one is sent on as it comes.
    """
    names = ("key", "salt", "kind", "n", "pos", "root")
    held, crowded = [np.empty(0, np.int64)] * 6, []  # crowded: the (key, salt) of which rows were sent on, and the one of which they are now

    def pairs(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows[0]):
            return
        new = np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0))
        key, salt, kind, n, pos, root = (x[new] for x in rows)
        lead = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        sizes = np.diff(np.append(lead, len(key)))
        split = salt[lead] > 0  # there are more elsewhere
        for k, part in crowded:
            split |= (key[lead] == k) & (salt[lead] == part)
        stay = np.repeat(split | (np.minimum.reduceat(root, lead) != np.maximum.reduceat(root, lead)), sizes)  # else all are connected
        many = np.repeat(split | (sizes > _CROWD), sizes)[stay]
        group = np.repeat(np.arange(len(lead)), sizes)[stay]
        key, kind, n, pos, root = (x[stay] for x in (key, kind, n, pos, root))
        if not len(key):
            return
        lead = np.flatnonzero(np.append(True, np.diff(group) != 0))
        sizes = np.diff(np.append(lead, len(key)))
        left, right = [], []
        for step in range(1, int(min(sizes.max(), _CROWD))):
            at = np.flatnonzero((group[step:] == group[:-step]) & (~many[step:] | (step <= _NEXT)))
            left.append(at)
            right.append(at + step)
        for k in np.flatnonzero(many[lead]):
            mine = np.arange(lead[k], lead[k] + sizes[k])
            left.append(np.minimum(mine, mine[len(mine) // 2]))
            right.append(np.maximum(mine, mine[len(mine) // 2]))
        a, b = np.concatenate([*left, np.empty(0, int)]), np.concatenate([*right, np.empty(0, int)])
        need = np.ceil(least / (1 + least) * (n[a] + n[b]) - 1e-9)
        fine = (n[a] >= least * n[b] - 1e-9) & (pos[a] <= n[a] - need) & (pos[b] <= n[b] - need) & (root[a] != root[b])
        both = np.unique(np.stack([np.maximum(kind[a], kind[b])[fine], np.minimum(kind[a], kind[b])[fine]]), axis=1)
        if both.size:
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(both.shape[1], pa.int64()), "u": both[0], "v": both[1], "pos": pa.nulls(both.shape[1], pa.int64())})
        if many.any():
            yield pa.RecordBatch.from_pydict({"key": key[many], "u": kind[many], "v": n[many], "pos": pos[many]})

    for batch in _together(batches, 100_000):
        held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names, strict=True)]
        if not len(held[0]):
            continue
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        cut, last = int(np.argmax(same)), (held[0][-1], held[1][-1])
        sent = len(same) - cut > _CROWD or last in crowded
        if sent:
            cut, crowded = len(same), [*crowded, last]
        yield from pairs(*(x[:cut] for x in held))
        crowded = [last] if sent else []
        held = [x[cut:] for x in held]
    yield from pairs(*held)


def _apart(crowd: DataFrame, least: float) -> DataFrame:
    """crowd (key, kind, n, pos, root, odd...) -> pairs (u, v) with different roots that size, place and parity bits allow.

    n - pos shingles at most are common, so the partner has at most (n - pos) x (1 + least) / least - n.  A node meets the larger ones
    (of equal ones, those of larger kind) up to that size, by bins of size; the larger one must allow the smaller likewise.
    """
    most = F.floor((F.col("n") - F.col("pos")) * ((1 + least) / least) - F.col("n") + 1e-9)
    step = lambda c: F.floor(F.log(F.col(c) + 0.5) / float(np.log(_RATIO))).cast("int")
    sized = crowd.withColumn("most", most).filter(F.col("most") >= F.ceil(least * F.col("n") - 1e-9))
    x = sized.filter("most >= n").withColumn("bin", F.explode(F.sequence(step("n"), step("most"))))
    y = sized.withColumn("bin", step("n"))
    columns = ("kind", "n", "most", "root", *_ODD)
    x, y = (t.select("key", "bin", *(F.col(c).alias(f"{c}_{k}") for c in columns)) for t, k in ((x, "x"), (y, "y")))
    fits = "(n_x < n_y OR (n_x = n_y AND kind_x < kind_y)) AND n_y <= most_x AND n_x <= most_y AND root_x <> root_y"
    odd = f"{' + '.join(f'bit_count({c}_x ^ {c}_y)' for c in _ODD)} <= n_x + n_y - 2 * ceil({least / (1 + least)} * (n_x + n_y) - 1e-9)"
    return x.join(y, ["key", "bin"]).filter(f"{fits} AND {odd}").select(F.greatest("kind_x", "kind_y").alias("u"), F.least("kind_x", "kind_y").alias("v"))


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "a"):
        good = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            shared = len(np.intersect1d(np.frombuffer(a, _U), np.frombuffer(b, _U), assume_unique=True))
            good.append(shared >= least / (1 + least) * (len(a) + len(b)) / 8 - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


class _Texts:
    """The texts of nodes, each once, and what compares them."""

    def __init__(self, texts: DataFrame, different: DataFrame, width: int, least: float, most: int):
        self.texts, self.different, self.width, self.least, self.most = texts, different, width, least, most

    def similar(self, pairs: DataFrame) -> DataFrame:
        """pairs (u, v) of kinds -> those whose sets are similar enough."""
        width, least = self.width, self.least
        wanted = settle(pairs.select(F.col("u").alias("kind")).union(pairs.select(F.col("v").alias("kind"))).distinct(), "wanted")
        ids = few(settle(self.different.join(wanted, "kind", "left_semi").select(F.col("low").alias("want")).distinct(), "ids"), self.most)
        found = self.texts.join(ids, F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text").mapInArrow(lambda it: _bodies(it, width), "kind long, body binary")
        bodies = settle(found.join(few(wanted, self.most), "kind", "left_semi").groupBy("kind").agg(F.first("body").alias("body")), "bodies", even=False)
        both = pairs.join(bodies.toDF("u", "a"), "u").join(bodies.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return settle(both.mapInArrow(lambda it: _verified(it, least), "u long, v long"), "links")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = 2_000_000) -> DataFrame:
    """One row per input row: id_col, component_id (the smallest id reachable over links).

    Tables of ids up to `most` rows are broadcast; where more rows repeat than that, texts are shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", F.hash("text"))
    all_ = settle(plain.mapInArrow(lambda it: _kinds(it, width), f"id long, mark int, kind long, n long, fp long, {', '.join(f'{c} long' for c in _ODD)}"), "kinds")
    different = settle(all_.groupBy("kind").agg(F.min("id").alias("low"), *(F.first(c).alias(c) for c in ("n", "fp", *_ODD))), "different")
    again = settle(all_.join(different.select("kind", "low"), "kind").filter("id <> low").select("id", "mark").distinct(), "again")
    texts = plain.join(few(again, most), ["id", "mark"], "left_anti").select("id", "text")
    if again.count() > most:
        texts = settle(texts, "texts", even=False)
    nodes = _Texts(texts, different, width, least, most)

    prints = settle(different.groupBy("fp").agg(F.min("kind").alias("first")), "prints")
    grid = components(near_links(prints, 2)).toDF("fp", "root_fp")
    stars = different.join(grid, "fp", "left").select("kind", F.coalesce("root_fp", "fp").alias("of")).join(prints.select(F.col("fp").alias("of"), "first"), "of").filter("kind <> first")
    close = nodes.similar(settle(stars.select(F.col("kind").alias("u"), F.col("first").alias("v")), "stars"))

    shared = spark.sparkContext.broadcast(_often(texts, width, different.agg(F.sum("n")).first()[0] or 0))
    met = texts.select("text").mapInArrow(lambda it: _prefixes(it, width, shared, least), "key long, salt long, kind long, n long, pos long")
    met = met.join(few(close.toDF("kind", "root"), most), "kind", "left").select("key", "salt", "kind", "n", "pos", F.coalesce("root", "kind").alias("root"))
    met = met.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "n", "kind")
    met = settle(met.mapInArrow(lambda it: _meet(it, least), "key long, u long, v long, pos long"), "met")
    links = close.union(nodes.similar(met.filter("key IS NULL").select("u", "v").distinct()))
    roots = components(links)
    crowd = met.filter("key IS NOT NULL").select("key", F.col("u").alias("kind"), F.col("v").alias("n"), "pos")
    crowd = crowd.join(roots.toDF("kind", "root"), "kind", "left").join(different.select("kind", *_ODD), "kind")
    crowd = settle(crowd.select("key", "kind", "n", "pos", F.coalesce("root", "kind").alias("root"), *_ODD), "crowd")
    apart = crowd.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    rest = settle(_apart(crowd.join(apart, "key", "left_semi"), least).distinct(), "rest")
    if not rest.isEmpty():
        roots = components(links.union(nodes.similar(rest)))
    rooted = different.join(roots, different["kind"] == roots["u"], "left").select("kind", "low", F.coalesce("v", "kind").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("kind", "component_id")
    return all_.select("id", "kind").join(named, "kind").select(F.col("id").alias(id_col), "component_id")


def keep_one_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, most: int = 2_000_000) -> DataFrame:
    """The document with the smallest id of each group, with its columns; rows whose id is null stay.

    If at most `most` ids go (some 50 MB), they are broadcast and no text is shuffled.
    """
    found = near_texts(docs, id_col, text_col, width, least, most).toDF("id", "low")
    gone = fresh("gone", docs.columns)
    out = settle(found.filter("id <> low").select(F.col("id").alias(gone)).distinct(), "gone")
    return docs.join(few(out, most), F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
