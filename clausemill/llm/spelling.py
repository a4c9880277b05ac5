"""Spelling variants: words of a corpus at most one edit apart, and the form that each of them is a variant of.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is its near word with
the largest count (ties: the smallest in code-point order), if that is at least `factor` times the word's own; its root is
what the forms lead to.

1. Words are counted: each task adds up its own before the shuffle, so a frequent word is one row for each task.
2. The words, in order, become tries of at most `shard_words` words each: nodes in breadth-first order, for each one the set of
   its letters (two 64-bit masks) and its first child, so a child is found by counting bits.
3. Tries are broadcast in blocks of at most `block_bytes`.  For each block every word is run through each trie depth-first
   by its Levenshtein automaton of distance one: along the word's own path, each node is left by one edit, and what is left of
   the word is followed to its end before the next node is taken.  Edits that give the same word are made once (within equal
   letters the first is deleted or doubled).  A task sends for each word how many near words the block has and the best of them.
4. These are added up over the blocks.  Roots follow by pointer doubling: counts at least double with each form, so a chain has
   at most 63 / log2(factor) steps, and a round halves it.

No pairs are shuffled or written.  The broadcast is bounded whatever the vocabulary; each further block is one more pass over the words
(not the texts), in which a word leaves a trie at the root unless its first letters are there.

Defined cases: null texts have no words; a null id counts as an empty one; repeated rows count again; a word alone has no form
and is its own root; an empty table gives no rows; other columns play no part.  A text's length doesn't matter; a word of a
million letters costs about a minute in one task, as its path has as many nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import partitions, settle
from clausemill.llm.words import slices

LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
_CELLS = 1 << 23
_WORDS = 8192


def mistyped(doc: Column, run: Column) -> Column:
    """The run, without one of its letters where 97 divides the crc32 of `doc:run`."""
    h = F.crc32(F.concat(doc, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: bool = False, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased (as mistyped() gives them if damaged), long and frequent enough."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(LETTERS), 0)).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    words = runs.select("doc", run.alias("run")).select((mistyped(F.col("doc"), F.col("run")) if damaged else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words as numbers from 1 in code-point order, padded with 0, a row for each word; and their lengths."""
    flat = words.cast(pa.large_string())
    data = np.frombuffer(b"".join(x.encode("latin-1") for x in flat.to_pylist()), np.uint8)
    sizes = np.array([len(x) for x in flat.to_pylist()], np.int64)
    letters = np.where(data < 0xC0, data - 0x60, data - (0xC0 - 27)).astype(np.uint8)
    out = np.zeros((len(sizes), int(sizes.max(initial=0)) + 1), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = letters
    return out, sizes


class Trie:
    """Sorted different words as a trie; node 0 is the root, children of a node follow each other in order of their letters."""

    def __init__(self, masks: np.ndarray, first: np.ndarray, label: np.ndarray, ends: np.ndarray):
        self.masks, self.first, self.label, self.ends = masks, first, label, ends

    @classmethod
    def of(cls, letters: np.ndarray, sizes: np.ndarray) -> Trie:
        same = np.zeros(len(sizes), np.int64)
        same[1:] = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1).sum(axis=1)
        node, parents, labels = np.zeros(len(sizes), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)]
        ends, total = np.zeros(len(sizes), np.int64), 1
        live = np.arange(len(sizes))
        for depth in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > depth]
            new = same[live] <= depth
            new[:1] = True
            parents.append(node[live][new])
            labels.append(letters[live, depth][new])
            node[live] = total + np.cumsum(new) - 1
            total += int(new.sum())
            done = live[sizes[live] == depth + 1]
            ends[done] = node[done]
        parent, label = np.concatenate(parents), np.concatenate(labels)
        masks = np.zeros((total, 2), _U)
        np.bitwise_or.at(masks, (parent[1:], label[1:] >> 6), _U(1) << (label[1:] & 63).astype(_U))
        first = (np.searchsorted(parent[1:], np.arange(total + 1)) + 1).astype(np.uint32)
        word = np.full(total, -1, np.int32)
        word[ends] = np.arange(len(sizes), dtype=np.int32)
        return cls(masks, first, label, word)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or 0."""
        low, high = self.masks[node, 0], self.masks[node, 1]
        upper, bit = letter >= 64, _U(1) << (letter & 63).astype(_U)
        mine = np.where(upper, high, low)
        before = np.bitwise_count(mine & (bit - _U(1))).astype(np.int64) + np.where(upper, np.bitwise_count(low), 0)
        return np.where(mine & bit, self.first[node] + before, 0)

    def near(self, letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word of `letters`, word of the trie) for all that are one edit apart, each pair once."""
        who, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        for at in range(letters.shape[1]):
            if not len(who):
                return
            own = letters[who, at]
            inside = sizes[who] > at
            last = letters[who, at - 1] if at else np.zeros(len(who), np.uint8)
            one = inside & (own != last)
            yield from self._rest(letters, sizes, who[one], node[one], np.full(int(one.sum()), at + 1))
            kids = (self.first[node + 1] - self.first[node]).astype(np.int64)
            begin = np.cumsum(kids) - kids
            from_ = np.repeat(np.arange(len(who)), kids)
            kid = self.first[node][from_].astype(np.int64) + np.arange(len(from_)) - begin[from_]
            letter = self.label[kid]
            put = letter != last[from_]
            yield from self._rest(letters, sizes, who[from_[put]], kid[put], np.full(int(put.sum()), at))
            other = inside[from_] & (letter != own[from_])
            yield from self._rest(letters, sizes, who[from_[other]], kid[other], np.full(int(other.sum()), at + 1))
            who, node, own = who[inside], node[inside], own[inside]
            node = self.child(node, own)
            who, node = who[node > 0], node[node > 0]

    def _rest(self, letters: np.ndarray, sizes: np.ndarray, who: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is left of words, followed without a further edit."""
        place = int(at[0]) if len(at) else 0
        while len(who):
            ended = sizes[who] == place
            if ended.any():
                word = self.ends[node[ended]]
                yield who[ended][word >= 0], word[word >= 0]
                who, node = who[~ended], node[~ended]
            if len(who):
                node = self.child(node, letters[who, place])
                who, node = who[node > 0], node[node > 0]
            place += 1


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted words -> tries of at most `most` words, fewer where words are very long."""

    def packed(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        trie = Trie.of(*_matrix(words))
        parts = {"masks": trie.masks, "first": trie.first, "label": trie.label, "ends": trie.ends, "n": n.astype(np.int64)}
        row = {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()} | {"words": pa.array(["\n".join(words.to_pylist())])}
        size = sum(v.nbytes for v in parts.values()) + len(row["words"][0].as_py())
        return pa.RecordBatch.from_pydict({"low": words[:1], "size": pa.array([size], pa.int64()), **row})

    words, n, longest = [], [], 0
    for batch in batches:
        for word, times in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            longest = max(longest, len(word))
            if words and (len(words) >= most or (len(words) + 1) * longest > 4 * _CELLS):
                yield packed(pa.array(words), np.array(n))
                words, n, longest = [], [], len(word)
            words.append(word)
            n.append(times)
    if words:
        yield packed(pa.array(words), np.array(n))


def _search(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    """Of each word that the block's tries have near words of: how many, and the best."""
    shards = []
    for x in block.value:
        read = lambda c, kind, x=x: np.frombuffer(x[c], kind)
        shards.append((Trie(read("masks", _U).reshape(-1, 2), read("first", np.uint32), read("label", np.uint8), read("ends", np.int32)), read("n", np.int64), x["words"].split("\n")))
    for batch in slices(batches, "word", 1 << 17):
        words = batch.column("word")
        longest = max((len(x) for x in words.to_pylist()), default=1)
        step = max(1, min(_WORDS, _CELLS // (longest + 1)))
        for begin in range(0, len(words), step):
            part = words.slice(begin, step)
            letters, sizes = _matrix(part)
            near, n, form = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.full(len(part), None, object)
            for trie, counts, names in shards:
                found = list(trie.near(letters, sizes))
                if not found:
                    continue
                mine, theirs = (np.concatenate(x) for x in zip(*found, strict=True))
                near += np.bincount(mine, minlength=len(part))
                order = np.lexsort((theirs, -counts[theirs], mine))
                lead = order[np.append(True, np.diff(mine[order]) != 0)[: len(order)]]
                lead = lead[counts[theirs[lead]] > n[mine[lead]]]
                n[mine[lead]] = counts[theirs[lead]]
                form[mine[lead]] = [names[k] for k in theirs[lead].tolist()]
            some = np.flatnonzero(near)
            yield pa.RecordBatch.from_pydict({"word": part.take(pa.array(some)), "near": near[some], "best_n": n[some], "best": pa.array(form[some].tolist(), pa.string())})


def near_words(words: DataFrame, shard_words: int = 1 << 18, block_bytes: int = 64 << 20) -> DataFrame:
    """word, n (each word once; lower-case letters of Latin-1) -> word, near, best, best_n for words that have near words."""
    spark = words.sparkSession
    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    tries = settle(ordered.mapInArrow(lambda it: _shards(it, shard_words), "low string, size long, masks binary, first binary, label binary, ends binary, n binary, words string"), "tries", even=False)
    queries = words.select("word").repartition(max(partitions(spark), spark.sparkContext.defaultParallelism))
    blocks: list[list[str]] = []
    room = 0
    for x in tries.select("low", "size").orderBy("low").collect():  # a row for each trie
        if not blocks or x["size"] > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(x["low"])
        room -= x["size"]
    found = []
    for lows in blocks:
        rows = sorted((r.asDict() for r in tries.filter(F.col("low").between(lows[0], lows[-1])).collect()), key=lambda r: r["low"])  # at most block_bytes, or one trie
        block = spark.sparkContext.broadcast(rows)
        found.append(settle(queries.mapInArrow(lambda it, block=block: _search(it, block), "word string, near long, best_n long, best string"), "near"))
        block.unpersist()
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n")).filter("false")
    if len(found) == 1:
        return found[0].select("word", "near", "best", "best_n")
    united = found[0]
    for x in found[1:]:
        united = united.union(x)
    order = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best"))
    return united.groupBy("word").agg(F.sum("near").alias("near"), F.min(order).alias("first")).select("word", "near", "first.best", (-F.col("first.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, form (never null, without circles) -> word, root."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: bool = False, least_length: int = 5, least_count: int = 3, factor: float = 2.0, shard_words: int = 1 << 18, block_bytes: int = 64 << 20) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word that is long and frequent enough."""
    if factor <= 1:
        raise ValueError("a form is more frequent than its variants: the factor is above 1")
    words = settle(count_words(docs, id_col, text_col, damaged, least_length, least_count), "words")
    near = near_words(words, shard_words, block_bytes).withColumnRenamed("word", "_word")
    good = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    formed = settle(joined, "forms")
    roots = _roots(formed.filter("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return formed.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
