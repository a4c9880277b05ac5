"""Removal of lines that many documents share, kept up to date as documents come and go.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, hashed to 128 bits.
LineIndex keeps, in a folder all executors share:

* postings: signed rows (k1, k2, id, rows) of the batches.  Their sums by key and id are the exact reference counts: an id holds
  a line if its sum is above zero.  Tables of as many batches are merged into one, rows that cancel left out, so n batches
  lie in about log2(n) tables and a row is written anew at most as often;
* the exact table of the keys now in `min_docs` documents or more, with the largest id of each;
* a cuckoo filter for each shard of keys that holds those keys.  Keys that cross the limit either way are inserted in and
  deleted from it; a filter without a crossing is carried over.  Shards are doubled, and filters built anew, where a shard
  would hold over `shard_keys` keys on average, so none grows with the corpus;
* a log of records, each the whole state after one batch.  A batch takes effect with its record, which is published under
  the next number by one writer only; another that comes second begins anew on top of it.  A batch whose name is in the
  log changes nothing.  Everything is read from the folder, so an index opened anew is the same index.

A batch counts its own keys anew over all postings and leaves the other keys as they are; postings of others are
read but not shuffled.

To drop lines, documents are probed against the filters, and only lines that hit are looked up in the exact table.  If
that table has at most `max_keys` keys, it is broadcast beside the filters, and no text is shuffled.  If it has more,
hits are joined with it: of the hits in one slice of a task a key is sent once with the list of its places, so a line
that a third of all documents hold stays small.  Filters are broadcast up to `max_filter_bytes`; if they are larger,
every long line is joined.  All ways give the same result.

Rule: keys of at least `min_chars` code points found in at least `min_docs` documents lose all their lines but those
of the largest id that holds them.  Defined cases: null or empty text is one empty line and stays so; documents are ids, so
rows that repeat an id count once; all null ids together are one document, smaller than any other; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.cuckoo import CuckooFilter
from clausemill.llm.shared import names, own_folder, partitions, publish, records, remove, small_batches
from clausemill.llm.words import signed, slices

_U = np.uint64
#: Shards follow from bits of a key that its filter uses neither for places (the lowest) nor for prints (the highest 16).
_SHARD_BITS = 24


class _Lines:
    """Lines of some texts; `at` are the places of those with a key long enough, k1 and k2 their keys."""

    def __init__(self, texts: pa.Array, min_chars: int):
        parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        self.flat = parts.flatten()
        self.counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        keys = pc.ascii_lower(pc.ascii_trim_whitespace(self.flat))
        long = pc.greater_equal(pc.utf8_length(keys), min_chars)
        self.at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        coded = keys.filter(long).dictionary_encode()
        wide = [xxhash.xxh3_128_intdigest(x) for x in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.k1 = np.array([x >> 64 for x in wide], _U)[codes] if wide else np.empty(0, _U)
        self.k2 = np.array([x & 0xFFFFFFFFFFFFFFFF for x in wide], _U)[codes] if wide else np.empty(0, _U)


def _postings(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines = _Lines(batch.column("text"), min_chars)
        owner = lines.owner[lines.at]
        order = np.lexsort((lines.k2, lines.k1, owner))
        new = np.append(True, (np.diff(owner[order]) != 0) | (np.diff(lines.k1[order]) != 0) | (np.diff(lines.k2[order]) != 0)) if len(order) else np.empty(0, bool)
        pick = order[new]
        yield pa.RecordBatch.from_pydict({"k1": signed(lines.k1[pick]), "k2": signed(lines.k2[pick]), "id": batch.column("id").take(pa.array(owner[pick]))})


def _update_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and step: 0 the filter as it was, 1 a key to delete, 2 a key to insert."""
    shard, held, gone, come = None, None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        gone_, come_ = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (gone, come))
        gone_, come_ = gone_.view(_U), come_.view(_U)
        now = CuckooFilter.from_bytes(held) if held is not None else CuckooFilter(len(come_))
        now.delete(gone_)
        now.insert(come_)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([now.to_bytes()], pa.binary())})

    for batch in batches:
        shards, steps = batch.column("shard").to_numpy(), batch.column("step").to_numpy()
        keys = batch.column("k1").to_numpy(zero_copy_only=False)
        for k in np.unique(shards):
            if k != shard:
                if shard is not None:
                    yield from close()
                shard, held, gone, come = int(k), None, [], []
            mine = shards == k
            if (mine & (steps == 0)).any():
                held = batch.column("filter")[int(np.flatnonzero(mine & (steps == 0))[0])].as_py()
            gone.append(keys[mine & (steps == 1)].astype(np.int64))
            come.append(keys[mine & (steps == 2)].astype(np.int64))
    if shard is not None:
        yield from close()


def _hits(k1: np.ndarray, shards: int, held: dict[int, CuckooFilter]) -> np.ndarray:
    """Whether the filter of each key's shard may hold it."""
    hit, shard = np.zeros(len(k1), bool), ((k1 >> _U(_SHARD_BITS)) & _U(shards - 1)).astype(np.int64)
    for k in np.unique(shard):
        if int(k) in held:
            mine = np.flatnonzero(shard == k)
            hit[mine] = held[int(k)].contains(k1[mine])
    return hit


def _drop(batches: Iterator[pa.RecordBatch], min_chars: int, shards: int, filters, exact) -> Iterator[pa.RecordBatch]:
    """Lines dropped in one pass: what the filters pass is looked up in the exact table, sorted by key."""
    held = {k: CuckooFilter.from_bytes(x) for k, x in filters.value.items()}
    k1, k2, keep = exact.value
    for batch in slices(batches, "text"):
        lines = _Lines(batch.column("text"), min_chars)
        ids = batch.column("id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        stay = np.ones(len(lines.owner), bool)
        hit = np.flatnonzero(_hits(lines.k1, shards, held))
        if len(hit) and len(k1):  # equal first halves stand side by side
            at = np.searchsorted(k1, signed(lines.k1[hit]))
            last = np.searchsorted(k1, signed(lines.k1[hit]), side="right")
            for step in range(int((last - at).max(initial=0))):
                row = np.minimum(at + step, len(k1) - 1)
                same = (at + step < last) & (k2[row] == signed(lines.k2[hit]))
                owner = lines.owner[lines.at[hit]]
                stay[lines.at[hit][same & (none[owner] | (number[owner] != keep[row]))]] = False
        left = np.bincount(lines.owner[stay], minlength=len(batch))
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)).astype(np.int32)), lines.flat.filter(pa.array(stay))), "\n")
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(lines.counts), pa.array(lines.counts - left), kept], names=[*batch.schema.names[:-2], "n_lines", "n_dropped", "kept_text"])


def _probe(batches: Iterator[pa.RecordBatch], min_chars: int, shards: int, filters) -> Iterator[pa.RecordBatch]:
    held = {k: CuckooFilter.from_bytes(x) for k, x in filters.value.items()} if filters is not None else None
    for batch in slices(batches, "text"):
        lines = _Lines(batch.column("text"), min_chars)
        hit = np.ones(len(lines.at), bool) if held is None else _hits(lines.k1, shards, held)
        at, k1, k2 = lines.at[hit], lines.k1[hit], lines.k2[hit]
        order = np.lexsort((k2, k1))
        at, k1, k2 = at[order], k1[order], k2[order]
        lead = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(at) else at
        owner = pa.array(lines.owner[at])
        places = pa.StructArray.from_arrays([batch.column("id").take(owner), batch.column("mark").take(owner), pa.array((at - lines.first[lines.owner[at]]).astype(np.int32))], names=["id", "mark", "line"])
        yield pa.RecordBatch.from_pydict({"k1": signed(k1[lead]), "k2": signed(k2[lead]), "places": pa.ListArray.from_arrays(pa.array(np.append(lead, len(at)).astype(np.int32)), places)})


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
        counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        first, drops = np.cumsum(counts) - counts, batch.column("drops")
        sizes = np.where(drops.is_null().to_numpy(zero_copy_only=False), 0, np.diff(drops.offsets.to_numpy()))
        keep = np.ones(int(counts.sum()), bool)
        keep[np.repeat(first, sizes) + drops.flatten().to_numpy(zero_copy_only=False)] = False
        owner = np.repeat(np.arange(len(batch)), counts)
        stay = np.bincount(owner[keep], minlength=len(batch))
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stay)).astype(np.int32)), parts.flatten().filter(pa.array(keep))), "\n")
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(counts), pa.array(counts - stay), kept], names=[*batch.schema.names[:-2], "n_lines", "n_dropped", "kept_text"])


_KEY = ["k1", "k2"]
_POSTINGS, _FREQUENT, _FILTERS = "k1 long, k2 long, id long, rows long", "k1 long, k2 long, n_docs long, keep long", "shard int, filter binary"


def _net(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*_KEY, "id").agg(F.sum("rows").alias("rows")).filter("rows <> 0")


class LineIndex:
    """Reference counts and filters of lines in the folder `path`; batches are named, and a name takes effect once."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 20, min_docs: int = 3, shards: int = 64, max_filter_bytes: int = 64 << 20, max_keys: int = 2_000_000, shard_keys: int = 1_000_000):
        """shards: how many there are at first, rounded up to a power of two."""
        self.spark, self.path, self.min_chars, self.min_docs, self.max_filter_bytes, self.max_keys, self.shard_keys = spark, path, min_chars, min_docs, max_filter_bytes, max_keys, shard_keys
        self.shards = 1 << (shards - 1).bit_length()
        small_batches(spark)

    def insert(self, batch: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Add the lines of these documents; False, and no change, if the batch is known."""
        min_chars = self.min_chars
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda it: _postings(it, min_chars), "k1 long, k2 long, id long")
        return self._commit(batch, lambda before: rows.withColumn("rows", F.lit(1).cast("long")))

    def delete(self, batch: str, ids: DataFrame, id_col: str = "doc_id") -> bool:
        """Take back all rows of the documents with these ids; False, and no change, if the batch is known."""
        gone = ids.select(F.col(f"`{id_col}`").cast("long").alias("gone")).distinct()
        return self._commit(batch, lambda before: before.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_semi").withColumn("rows", -F.col("rows")))

    def _log(self) -> list[dict]:
        return list(records(self.spark, f"{self.path}/log").values())

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _commit(self, batch: str, changes: Callable[[DataFrame], DataFrame]) -> bool:
        while True:
            log = self._log()
            if any(x["batch"] == batch for x in log):
                return False
            record = self._next(log, changes)
            if publish(self.spark, f"{self.path}/log", f"{len(log):08d}", {"batch": batch, **record}):
                return True

    def _next(self, log: list[dict], changes: Callable[[DataFrame], DataFrame]) -> dict:
        """The tables as they are after a batch; those of before stay."""
        last = log[-1] if log else None
        runs = last["runs"] if last else []
        before = [path for path, _ in runs]
        own = self._write(_net(changes(self._read(before, _POSTINGS))), "postings")
        now = self._read([own], _POSTINGS)
        if last:
            frequent = self._read([last["frequent"]], _FREQUENT)
            touched = self._read([self._write(now.select(*_KEY).distinct(), "touched")], "k1 long, k2 long")
            now = _net(self._read([*before, own], _POSTINGS).join(touched, _KEY, "left_semi"))
            were, others = frequent.join(touched, _KEY, "left_semi"), frequent.join(touched, _KEY, "left_anti")
        counts = now.filter("rows > 0").groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keep")).filter(F.col("n_docs") >= self.min_docs)
        whole = self._write(others.unionByName(counts) if last else counts, "frequent")
        known = self._read([whole], _FREQUENT)
        shards, n = (last["shards"] if last else self.shards), known.count()
        while shards * self.shard_keys < n:
            shards *= 2
        state = {"runs": self._merged([*runs, [own, 1]]), "frequent": whole, "shards": shards}
        placed = lambda df: df.withColumn("shard", F.shiftrightunsigned("k1", _SHARD_BITS).bitwiseAND(F.lit(shards - 1)).cast("int"))
        step = lambda df, k: placed(df).select("shard", F.lit(k).alias("step"), "k1", F.lit(None).cast("binary").alias("filter"))
        if not last or shards != last["shards"]:
            return state | {"filters": self._write(self._filters(step(known, 2), shards), "filters")}
        mine = known.join(touched, _KEY, "left_semi")
        crossed = self._read([self._write(step(mine.join(were, _KEY, "left_anti"), 2).unionByName(step(were.join(mine, _KEY, "left_anti"), 1)), "crossed")], "shard int, step int, k1 long, filter binary")
        filters = self._read([last["filters"]], _FILTERS)
        open_ = filters.filter("length(filter) = 0").select("shard")
        changed = F.broadcast(crossed.select("shard").union(open_).distinct())  # at most as many as there are shards
        held = filters.filter("length(filter) > 0").join(changed, "shard", "left_semi").select("shard", F.lit(0).alias("step"), F.lit(0).cast("long").alias("k1"), "filter")
        steps = held.unionByName(crossed.join(F.broadcast(open_), "shard", "left_anti")).unionByName(step(placed(known).join(F.broadcast(open_), "shard", "left_semi"), 2))
        return state | {"filters": self._write(filters.join(changed, "shard", "left_anti").unionByName(self._filters(steps, shards)), "filters")}

    def _merged(self, runs: list[list]) -> list[list]:
        """Tables of postings with the number of batches in each: the last ones are merged while they hold as many as those before."""
        runs, last, n = runs[:-1], [runs[-1][0]], runs[-1][1]
        while runs and runs[-1][1] <= n:
            path, more = runs.pop()
            last, n = [path, *last], n + more
        return [*runs, [self._write(_net(self._read(last, _POSTINGS)), "postings") if len(last) > 1 else last[0], n]]

    def _filters(self, steps: DataFrame, shards: int) -> DataFrame:
        return steps.repartition(min(shards, partitions(self.spark)), "shard").sortWithinPartitions("shard", "step").mapInArrow(_update_filters, _FILTERS)

    def vacuum(self) -> None:
        """Delete the tables of earlier states and of batches that came second; no other writer or reader may be at work."""
        log = self._log()
        keep = {path for x in log[-1:] for path, _ in x["runs"]} | {x[k] for x in log[-1:] for k in ("frequent", "filters")}
        for kind in ("postings", "frequent", "filters", "touched", "crossed"):
            for name in names(self.spark, f"{self.path}/{kind}"):
                if f"{self.path}/{kind}/{name}" not in keep:
                    remove(self.spark, f"{self.path}/{kind}/{name}")

    @property
    def filters(self) -> DataFrame:
        """shard, filter: the cuckoo filters as bytes."""
        return self._read([self._last()["filters"]], _FILTERS)

    def _last(self) -> dict:
        log = self._log()
        if not log:
            raise ValueError("no batch yet")
        return log[-1]

    def frequent(self) -> DataFrame:
        """k1, k2, n_docs, keep: the lines now in min_docs documents or more, and the id that keeps them."""
        return self._read([self._last()["frequent"]], _FREQUENT)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """The documents' columns `keep`, then n_lines, n_dropped, kept_text."""
        last = self._last()
        frequent, table = self._read([last["frequent"]], _FREQUENT), self._read([last["filters"]], _FILTERS)
        small = (table.agg(F.sum(F.length("filter"))).first()[0] or 0) <= self.max_filter_bytes
        filters = self.spark.sparkContext.broadcast({x["shard"]: bytes(x["filter"]) for x in table.collect()}) if small else None
        min_chars, shards = self.min_chars, last["shards"]
        own = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)])
        added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
        carried = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]
        if small and frequent.count() <= self.max_keys:
            keys = frequent.filter("keep IS NOT NULL").select("k1", "k2", "keep").toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
            exact = self.spark.sparkContext.broadcast([keys.column(c).to_numpy() for c in ("k1", "k2", "keep")])
            rows = docs.select(*carried, F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
            return rows.mapInArrow(lambda it: _drop(it, min_chars, shards, filters, exact), T.StructType(own.fields + added)).toDF(*keep, "n_lines", "n_dropped", "kept_text")
        plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", F.hash("text"))
        hits = plain.mapInArrow(lambda it: _probe(it, min_chars, shards, filters), "k1 long, k2 long, places array<struct<id:long,mark:int,line:int>>")
        drops = hits.join(frequent.select("k1", "k2", "keep"), ["k1", "k2"]).select("keep", F.explode("places").alias("p")).filter("keep IS NOT NULL AND NOT (p.id <=> keep)").groupBy(F.col("p.id").alias("drop_id"), F.col("p.mark").alias("drop_mark")).agg(F.collect_list("p.line").alias("drops"))
        left = docs.select(*carried, F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", F.hash("text"))
        both = left.join(drops.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("mark") == F.col("drop_mark")), "left").select(*(f"c{k}" for k in range(len(keep))), "text", "drops")
        return both.mapInArrow(_rebuild, T.StructType(own.fields + added)).toDF(*keep, "n_lines", "n_dropped", "kept_text")


def index_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> LineIndex:
    """An index of these documents in a folder of this session, deleted as it ends."""
    index = LineIndex(docs.sparkSession, own_folder(docs.sparkSession, "lines"), **settings)
    index.insert("first", docs, id_col, text_col)
    return index


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with their columns, repeated lines dropped from the text; chars_col, if there, counts it anew."""
    others = [c for c in docs.columns if c not in (text_col, chars_col)]
    out = index_lines(docs, id_col, text_col).apply(docs, id_col, text_col, tuple(others))
    out = out.toDF(*(f"c{k}" for k in range(len(others))), "n_lines", "n_dropped", "kept_text")
    place = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {text_col: F.col("kept_text")}
    if chars_col in docs.columns:
        place[chars_col] = F.char_length("kept_text").cast(docs.schema[chars_col].dataType)
    return out.select(*(place[c].alias(c) for c in docs.columns))
