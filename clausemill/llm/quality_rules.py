"""Quality rules whose cutoffs follow the data of each language and source.

Base measures come from whole texts.  For each (language, source) a quantile sketch is kept for four ratios: counts of
integer values in buckets of 32 steps to the octave (relative error below 1/32).  Counts add, so sketches of tasks,
sources or days merge exactly and in any order.  The merged sketches give each group its own fences; a group with fewer
than `min_rows` documents takes the merged sketch of its language, then of all documents.  Documents are then joined
with the fences of their group.

* Word length (both sides): the middle half of the group's documents, and `SPREADS` times its width to each side.  It is
  wider for short documents (twice as wide at 20 words), whose means vary more.  A width below 0.1 characters counts as that.
* Symbols, repeated lines, repeated words (high side): most documents of a group have none or few, so quartiles say
  nothing.  Walking up from the group's median, the bulk ends at the first value after which the sketch has a valley: an
  octave (from u to twice u, both plus `least`) that holds at most `VALLEY` of a million of the group's documents.  The
  fence is the geometric middle of the valley.  A group without a valley has no fence: its tail is its own way of
  writing, and nothing is rejected.  `least` keeps a valley between values that are all small from counting.

base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.  kept: not base_failed and
inside all fences.  Sketches hold documents that pass the base rules.

Defined cases: null text has no words and fails; null language or source is a group of its own; a group without
documents has no sketch; repeated rows count each time; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.shared import fresh, settle, small_batches
from clausemill.llm.words import Words, mix, runs, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratio, numerator, denominator, scale, least width or value that counts (scaled); and whether low values fail too.
RATIOS = (
    ("word_length", "word_chars", "n_words", 1000, 100, True),
    ("symbols", "n_symbols", "word_chars", 10000, 200, False),
    ("dup_lines", "n_dup_lines", "n_words", 10000, 150, False),
    ("repeats", "n_repeat_words", "n_words", 10000, 700, False),
)
SPREADS, VALLEY = 6, 2000
_U = np.uint64


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    n, texts = len(texts), pc.fill_null(texts, "")
    words = Words(texts)
    out = {"n_words": words.counts, "word_chars": np.bincount(words.owner, pc.utf8_length(words.flat).to_numpy(zero_copy_only=False), n)}
    out["n_symbols"] = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    owner, flat = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy())), lines.flatten()
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[real].astype(np.int64)
    seen, times = np.unique(owner[real].astype(np.int64) << 32 | codes, return_counts=True)
    out["n_dup_lines"] = np.bincount(seen >> 32, times - 1, n)
    windows = runs(words.hashes(), 5)
    at = np.flatnonzero(words.owner[: len(windows)] == words.owner[4:]) if len(windows) else np.empty(0, int)
    keyed = mix(windows[at] + words.owner[at].astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    hit = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    out["n_repeat_words"] = np.bincount(words.owner[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_measures(docs: DataFrame, text_col: str, keep: list[str], names: dict[str, str]) -> DataFrame:
    """The columns `keep`, and the base measures under the names given."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[m], T.LongType()) for m in MEASURES])
    position = {c: k for k, c in enumerate(dict.fromkeys([*keep, text_col]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = _measure(batch.column(position[text_col]))
            yield pa.RecordBatch.from_arrays([batch.column(position[c]) for c in keep] + [pa.array(found[m]) for m in MEASURES], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in position)).mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """Bucket of an integer from 0: itself below 64, then 32 to each octave."""
    over = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (over * 32 + F.call_function("shiftright", value, over)).cast("int")


def bucket_top(number: Column) -> Column:
    """The largest integer in a bucket."""
    over = F.greatest(F.floor((number - 32) / 32), F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - over * 32 + 1).cast("long"), over) - 1


def _base_failed(names: dict[str, str], min_words: int, repeat_percent: int) -> Column:
    n = F.col(names["n_words"])
    return (n < min_words) | (F.col(names["n_repeat_words"]) * 100 > n * repeat_percent)


def _ratio(names: dict[str, str], over: str, under: str, scale: int) -> Column:
    below = F.col(names[under])
    return F.when(below > 0, F.floor(F.col(names[over]) * scale / below)).otherwise(0).cast("long")


def sketches(measured: DataFrame, lang_col: str, source_col: str, names: dict[str, str], min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Mergeable sketches: lang, source, ratio, bucket, rows."""
    ratios = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(_ratio(names, a, b, s)).alias("bucket")) for k, (_, a, b, s, *_) in enumerate(RATIOS))))
    passed = measured.filter(~_base_failed(names, min_words, repeat_percent))
    return passed.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), ratios.alias("x")).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("rows"))


def _limits_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, low, high, of: the fences of each group, by its merged sketch of at most some 1,100 buckets."""
    group = Window.partitionBy(*keys, "ratio")
    run = counts.groupBy(*keys, "ratio", "bucket").agg(F.sum("rows").alias("rows"))
    run = run.withColumns({"upto": F.sum("rows").over(group.orderBy("bucket")), "of": F.sum("rows").over(group), "last": F.max("bucket").over(group)})
    run = run.withColumn("share", F.expr("upto * 1000000 div of"))
    run = run.withColumn("ahead", F.coalesce(F.min("bucket").over(group.orderBy("share").rangeBetween(VALLEY + 1, Window.unboundedFollowing)), "last"))
    least = reduce(lambda c, k: c.when(F.col("ratio") == k, RATIOS[k][4]), range(1, len(RATIOS)), F.when(F.col("ratio") == 0, RATIOS[0][4])).cast("double")
    start, end = bucket_top(F.col("bucket")) + least, bucket_top(F.col("ahead") - 1) + 1 + least
    run = run.withColumn("cut", F.when((F.col("share") >= 500_000) & (F.col("ahead") > F.col("bucket")) & (end >= 2 * start), F.floor(F.sqrt(start * end)) - least))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), bucket_top(F.col("bucket"))))
    found = run.groupBy(*keys, "ratio").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.min_by("cut", F.when(F.col("cut").isNotNull(), F.col("bucket"))).cast("long").alias("cut"), F.max("of").alias("of"))
    both, reach = F.col("ratio").isin([k for k, x in enumerate(RATIOS) if x[5]]), F.greatest(F.col("q3") - F.col("q1"), least.cast("long")) * SPREADS
    return found.select(*keys, "ratio", F.when(both, F.col("q1") - reach).alias("low"), F.when(both, F.col("q3") + reach).otherwise(F.col("cut")).alias("high"), "of")


def fences(counts: DataFrame, min_rows: int = 50) -> DataFrame:
    """lang, source, and for each ratio k the least and largest value that pass: low_k, high_k (null: no fence)."""
    own, by_lang, by_all = _limits_of(counts, ["lang", "source"]), _limits_of(counts, ["lang"]), _limits_of(counts, [])
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    x = named(own, "o").join(named(by_lang, "l"), F.expr("o_lang <=> l_lang AND o_ratio = l_ratio"), "left").join(named(by_all, "a"), F.expr("o_ratio = a_ratio"), "left")
    pick = lambda q: F.when(F.col("o_of") >= min_rows, F.col(f"o_{q}")).when(F.col("l_of") >= min_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    x = x.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_ratio").alias("ratio"), pick("low").alias("low"), pick("high").alias("high"))
    return x.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{c}_{k}") for k in range(len(RATIOS)) for c in ("low", "high")))


def _limits(counts: DataFrame, most: int = 200_000) -> DataFrame:
    """Fences as a table: broadcast if it has at most `most` groups (some 20 MB), else joined by shuffle."""
    limits = settle(fences(counts), "fences")
    return F.broadcast(limits) if limits.count() <= most else limits


def _judged(measured: DataFrame, limits: DataFrame, lang_col: str, source_col: str, names: dict[str, str], failed: str, kept: str, min_words: int, repeat_percent: int) -> DataFrame:
    own = limits.select(*(F.col(c).alias(fresh(f"limit_{c}", measured.columns)) for c in limits.columns))
    of = dict(zip(limits.columns, own.columns, strict=True))
    both = measured.join(own, F.col(f"`{lang_col}`").eqNullSafe(F.col(of["lang"])) & F.col(f"`{source_col}`").eqNullSafe(F.col(of["source"])), "left")
    inside = []
    for k, (_, a, b, s, _, two_sided) in enumerate(RATIOS):
        value, low, high = _ratio(names, a, b, s), F.col(of[f"low_{k}"]), F.col(of[f"high_{k}"])
        wider = (high - low) * 10 / F.greatest(F.col(names["n_words"]), F.lit(1))
        inside.append(F.coalesce((value <= high + wider) & (value >= low - wider) if two_sided else value <= high, F.lit(True)))
    return both.withColumns({failed: _base_failed(names, min_words, repeat_percent), kept: ~_base_failed(names, min_words, repeat_percent) & reduce(lambda x, y: x & y, inside)}).drop(*own.columns)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """One row per document: id, the base measures, base_failed, kept."""
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    names = {m: m for m in MEASURES}
    measured = settle(with_measures(own, "text", ["id", "lang", "source"], names), "measures")
    limits = _limits(sketches(measured, "lang", "source", names, min_words, repeat_percent))
    out = _judged(measured, limits, "lang", "source", names, "base_failed", "kept", min_words, repeat_percent)
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """The documents that pass, with their columns.  Measures are taken twice, so that no text is shuffled."""
    names = {m: fresh(m, docs.columns) for m in MEASURES}
    limits = _limits(settle(sketches(with_measures(docs, text_col, [lang_col, source_col], names), lang_col, source_col, names, min_words, repeat_percent), "sketches"))
    kept = fresh("kept", docs.columns)
    out = _judged(with_measures(docs, text_col, docs.columns, names), limits, lang_col, source_col, names, fresh("base_failed", docs.columns), kept, min_words, repeat_percent)
    return out.filter(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
