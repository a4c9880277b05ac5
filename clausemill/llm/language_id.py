"""Language identification by unigram pieces, with all segmentations summed.

The vocabulary is a fixed public one.  A language gives each piece a probability; the probability of a word is the sum
over all ways to spell it with pieces, by a forward pass over the word's lattice; a text is its words, independent.
Equal words are scored once per slice, for all languages in one pass.

Training.  Labelled rows are sampled to at most `train_rows` different texts of each language (chosen by a hash of the
text, bounded whatever the corpus; the model is `languages` x `pieces` numbers).  Each piece counts as often as it is used
over all segmentations of a word under the vocabulary's own piece weights, in whole 2^-20ths, so that sums are exact and the
model is a function of the set of labelled texts: batches, partitions, retries and repeated rows do not change it.  Counts
are smoothed towards the mean of all languages with weight `smoothing`.

Words: the text cut at ASCII white space, lower-cased, without marks and digits around it; words without letters play
no part.  A pass goes letter by letter through all words of a slice at once, so a slice costs as many steps as its longest word has
letters: about 45 s for a million without a space.  Score: the posterior of the best language, priors as in the sample.  Ties go to the name that sorts first.

Defined cases: null text, or text without a letter, or no training rows at all: `und` and score 0; null labels are
not learned from; repeated rows are learned from once and each get a row; null or repeated ids play no part; the label of a row is no input of its prediction; other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.lattice import Lattice, Vocabulary
from clausemill.llm.sentencepiece_codec import MODEL
from clausemill.llm.shared import fresh, settle, small_batches
from clausemill.llm.words import Words, slices

UNKNOWN = "und"
_EDGES = "0123456789.,;:!?()[]{}<>\"'`*#$%&|/\\+=~^_@-"
_WHOLE = 1 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text of each word, its number among different words, and those words, each with a leading space."""
    words = Words(texts)
    flat = pc.utf8_trim(pc.utf8_lower(words.flat), _EDGES)
    real = pc.match_substring_regex(flat, r"\p{L}")
    coded = flat.filter(real).dictionary_encode()
    different = pc.binary_join_element_wise("", coded.dictionary, " ") if len(coded.dictionary) else coded.dictionary
    return words.owner[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False), different.to_pylist()


def _count_pieces(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary, log_p = shared.value
    for batch in slices(batches, "text", 3 << 19):
        owner, which, different = _words(batch.column("text"))
        if not len(owner):
            continue
        coded = batch.column("lang").dictionary_encode()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        lattice = Lattice(vocabulary, different)
        used = np.rint(lattice.expected(log_p) * _WHOLE).astype(np.int64)
        string = np.searchsorted(lattice.base, lattice.start, side="right") - 1
        both, times = np.unique(lang * len(different) + which, return_counts=True)
        turn = np.argsort(string, kind="stable")
        many = np.bincount(string, minlength=len(different))
        begin, word = np.cumsum(many) - many, both % len(different)
        size = many[word]
        edge = turn[np.repeat(begin[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        keys, place = np.unique(np.repeat(both // len(different), size) << 32 | (lattice.piece[edge].astype(np.int64) + 1), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, place, used[edge] * np.repeat(times, size))
        yield pa.RecordBatch.from_pydict({"lang": coded.dictionary.take(pa.array(keys >> 32)), "piece": ((keys & 0xFFFFFFFF) - 1).astype(np.int32), "n": n})


class LanguageModel:
    """Names of the languages, log probabilities (piece, language), log priors; and the vocabulary they are over."""

    def __init__(self, names: list[str], log_p: np.ndarray, prior: np.ndarray, vocabulary: Vocabulary):
        self.names, self.log_p, self.prior, self.vocabulary = names, log_p, prior, vocabulary

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        owner, which, different = _words(texts)
        n, score = len(texts), np.zeros(len(texts))
        if not len(owner) or not self.names:
            return [UNKNOWN] * n, score
        lattice = Lattice(self.vocabulary, different)
        word = lattice.forward(self.log_p)[lattice.last]
        total = np.stack([np.bincount(owner, word[which, k], n) for k in range(len(self.names))], axis=1) + self.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.bincount(owner, minlength=n) > 0
        return [self.names[k] if has else UNKNOWN for k, has in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def sample_rows(labelled: DataFrame, train_rows: int) -> DataFrame:
    """lang, text, h1: at most train_rows different texts of each language, the least by a hash of the text.

    The rate at which texts are looked at follows from an estimate of how many different ones a language has (2 %, where a
    fifth more are taken than needed), which like the sample itself is a function of the set of texts.
    """
    draw = labelled.select("lang", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).withColumn("draw", F.pmod("h1", F.lit(1 << 30)))
    rate = draw.groupBy("lang").agg(F.approx_count_distinct("h1", 0.02).alias("of")).select(F.col("lang").alias("of_lang"), (F.lit(train_rows * 1.2 + 100) / F.col("of") * (1 << 30)).alias("rate"))
    rate = settle(rate, "rates")
    if rate.count() <= 10_000:  # languages; no text is shuffled but the sample's
        rate = F.broadcast(rate)
    few = draw.join(rate, F.col("lang") == F.col("of_lang")).filter("draw < rate").groupBy("lang", "draw", "h1", "h2").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("draw", "h1", "h2")
    return few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= train_rows).select("lang", "text", "h1")


def train(labelled: DataFrame, train_rows: int = 1500, smoothing: float = 200.0, model: str = MODEL) -> LanguageModel:
    """labelled: lang, text; other columns play no part."""
    spark = labelled.sparkSession
    vocabulary = Vocabulary.from_model(model)
    shared = spark.sparkContext.broadcast((vocabulary, vocabulary.zipf()))
    sample = sample_rows(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), train_rows).repartition(spark.sparkContext.defaultParallelism, "h1")
    counted = sample.select("lang", "text").mapInArrow(lambda it: _count_pieces(it, shared), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # at most languages x pieces
    names = sorted({x["lang"] for x in rows})
    counts = np.zeros((len(vocabulary.pieces) + 1, len(names)))
    place = {name: k for k, name in enumerate(names)}
    for x in rows:
        counts[x["piece"], place[x["lang"]]] = x["n"] / _WHOLE
    if not names:
        return LanguageModel([], np.zeros((len(counts), 0)), np.zeros(0), vocabulary)
    mean = (counts / counts.sum(axis=0)).mean(axis=1)
    mean = 0.98 * mean + 0.02 * np.exp(vocabulary.zipf())
    total = np.maximum(counts + smoothing * mean[:, None], 1e-12)
    return LanguageModel(names, np.log(total / total.sum(axis=0)), np.log(counts.sum(axis=0) / counts.sum()), vocabulary)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: id_col, the columns `keep`, lang_pred, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.select(*(keep or [])).columns
    own, said = fresh("id", names), fresh("text", names)
    inner = docs.select(F.col(f"`{id_col}`").alias(own), *(keep or []), F.col(f"`{text_col}`").alias(said))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, said, 3 << 19):
            lang, score = shared.value.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score)], names=[own, *names, "lang_pred", "score"])

    return inner.mapInArrow(run, f"{schema}, lang_pred string, score double").withColumnRenamed(own, id_col)
