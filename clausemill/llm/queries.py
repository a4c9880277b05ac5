"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import secret_scan
from clausemill.llm.conversation_repair import damage, digests, repair
from clausemill.llm.decontaminate import find_items
from clausemill.llm.language_id import predict, train
from clausemill.llm.line_dedup import index_lines
from clausemill.llm.quality_rules import quality_report
from clausemill.llm.sentencepiece_codec import encode
from clausemill.llm.shared import own_folder, settle
from clausemill.llm.sharding import SLOTS, place
from clausemill.llm.simhash_dedup import near_duplicates
from clausemill.llm.spelling import variants
from clausemill.llm.substring_dedup import dedup_substrings
from clausemill.llm.token_counts import TokenRollup, count_tokens
from clausemill.llm.url_filters import duckdb_sql, judge_urls

SHARDS = [f"shard-{k:03d}" for k in range(100)]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, load them again (a retry, without effect), revise the counts of documents with repeated lines, delete toxic ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    counted = count_tokens(docs.withColumn("once", F.when(once != F.col("text"), once)), ["text", "once"])
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    state = settle(counted.join(toxic, F.col("doc_id") == F.col("toxic_id"), "left").withColumn("version", F.lit("byte_bpe_50k")), "counted")
    rollup = TokenRollup(spark, own_folder(spark, "rollup"))
    keys, now = ["source", "lang", "version"], F.when(F.col("n_1") > 0, F.col("n_1")).otherwise(F.col("n_0"))
    load = state.select(*keys, F.lit("insert").alias("op"), F.col("n_0").alias("n_tokens"), F.lit(0).alias("old_tokens"))
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("revise", state.filter("n_1 > 0").select(*keys, F.lit("revise").alias("op"), F.col("n_1").alias("n_tokens"), F.col("n_0").alias("old_tokens")))
    rollup.commit("takedown", state.filter("toxic_id IS NOT NULL").select(*keys, F.lit("delete").alias("op"), now.alias("n_tokens"), F.lit(0).alias("old_tokens")))
    return rollup.totals()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_pieces", F.lower(F.lpad(F.hex(F.xxhash64("token_ids")), 16, "0")).alias("ids_hash"), "lossless")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out).select("lang", "text"))
    return predict(docs, model, keep=[held_out.alias("held_out")])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = index_lines(docs).apply(docs, keep=("doc_id",))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("toxic") == 1).alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), RULES, labels).drop("purity")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"), damaged=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(damage(_table(spark, sf_dir, "conversations")), times_col="times")
    return repaired.report.join(digests(repaired).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_sentencepiece,
        op4_sharding,
        op5_language_id,
        op6_decontamination,
        op7_line_dedup,
        op8_url_filters,
        op9_simhash_near_dedup,
        op10_quality_rules,
        op11_spelling_variants,
        op12_conversation_repair,
        op13_secret_scan,
    )
}


def _op4_sql() -> str:
    """The table by another road: each shard's order of preference as numbers that run on, then turns."""
    import hashlib

    from_hex = lambda x: int(x, 16)
    orders = []
    for name in SHARDS:
        h = hashlib.md5(name.encode()).hexdigest()
        first, step = from_hex(h[:15]), from_hex(h[17:]) % (SLOTS - 1) + 1
        orders.append(x % SLOTS for x in range(first, first + SLOTS * step, step))
    table: dict[int, str] = {}
    while len(table) < SLOTS:
        for name, order in zip(SHARDS, orders, strict=True):
            if len(table) < SLOTS:
                table[next(x for x in order if x not in table)] = name
    owners = ",".join(table[k].removeprefix("shard-") for k in range(SLOTS))
    slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER"
    return f"WITH t AS (SELECT string_split('{owners}', ',') AS owners) SELECT doc_id, {slot} AS slot, 'shard-' || owners[{slot} + 1] AS shard FROM documents, t"


_OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), keyed AS (
  SELECT doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, k, line, f.key IS NOT NULL AND doc_id <> f.keep AS gone FROM keyed LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
_CRC = "crc AS (SELECT list(list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc FROM range(256) r(n))"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8, byte by byte through the table of _CRC."""
    hexed = f"hex(encode({text}))"
    return f"xor(list_reduce(list_transform(generate_series(1, length({hexed}), 2), lambda k: ('0x' || substr({hexed}, k::INTEGER, 2))::BIGINT), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


#: Near words share a pattern with one letter open, or one is the other without a letter.
_OP11 = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
hashed AS (SELECT run, m, {_crc32("doc || ':' || run")} AS h FROM (SELECT doc, run, count(*) AS m FROM runs GROUP BY ALL), crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, m FROM hashed),
words AS (SELECT word, sum(m)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
places AS (SELECT word, unnest(generate_series(1, length(word))) AS k FROM words),
holes AS (SELECT word, substr(word, 1, k::INTEGER - 1) || '?' || substr(word, k::INTEGER + 1) AS hole, substr(word, 1, k::INTEGER - 1) || substr(word, k::INTEGER + 1) AS less FROM places),
near AS (SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word UNION SELECT word, less FROM holes WHERE less IN (SELECT word FROM words) UNION SELECT less, word FROM holes WHERE less IN (SELECT word FROM words)),
ranked AS (SELECT w.word, w.n, x.word AS form, x.n AS form_n, count(*) OVER (PARTITION BY w.word) AS n_near, row_number() OVER (PARTITION BY w.word ORDER BY x.n DESC, encode(x.word)) AS k FROM words w JOIN near ON near.word = w.word JOIN words x ON x.word = near.other),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN formed f ON f.word = chain.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, chain.root FROM formed f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""
#: Row by row from the end of each conversation: of all edits that lead to a role, the cheapest and then the least.
_OP12 = f"""
WITH RECURSIVE {_CRC},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM keyed JOIN convs ON keyed.conv_id IS NOT DISTINCT FROM convs.conv_id, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (SELECT *, role || ':' || text AS line, substr(role, 1, 1) AS first, row_number() OVER w AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
faults AS (SELECT *, CASE WHEN regexp_replace(bare, '[\x20\x09-\x0D]+', '', 'g') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN substr(bare, length(bare), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lead(first) OVER (PARTITION BY c ORDER BY i) AS following FROM ordered),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (following IS NOT NULL AND first || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM faults GROUP BY c),
moves(s, t, kind, put) AS (VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'T', NULL), (0, 2, 'T', NULL), (0, 3, 'T', 'user:'), (1, 2, 'T', NULL), (1, 3, 'T', 'user:'), (2, 2, 'T', 'assistant:'), (2, 3, 'T', NULL), (3, 2, 'T', NULL), (3, 3, 'T', 'user:')),
roles(t, letter, name) AS (VALUES (0, '', ''), (1, 's', 'system'), (2, 'u', 'user'), (3, 'a', 'assistant')),
ends(s, cost, audit, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 10, 'II', ['user:', 'assistant:']), (2, 5, 'I', ['assistant:']), (3, 0, '', [])),
best AS (
  SELECT c, rows + 1 AS i, s, cost, audit, lines FROM counts, ends
  UNION ALL
  SELECT c, i, s, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) AS k FROM (
      SELECT f.c, f.i, m.s, CASE WHEN kind = 'D' THEN 2 ELSE (first <> letter)::INTEGER + CASE WHEN put IS NULL THEN 0 ELSE 5 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END + b.cost AS cost,
        CASE WHEN kind = 'D' THEN 'D' ELSE CASE WHEN put IS NULL THEN '' ELSE 'I' END || CASE WHEN first = letter THEN 'K' ELSE 'R' END END || b.audit AS audit,
        CASE WHEN kind = 'D' THEN b.lines ELSE CASE WHEN put IS NULL THEN [] ELSE [put] END || [CASE WHEN first = letter THEN line ELSE name || ':' || text END] || b.lines END AS lines
      FROM best b JOIN faults f ON f.c = b.c AND f.i = b.i - 1 JOIN moves m ON m.t = b.s JOIN roles r ON r.t = m.t
      WHERE kind = 'D' OR fault NOT IN ('blank', 'duplicate') AND (m.t <> 1 OR first = 's')
    )
  ) WHERE k = 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (c) LEFT JOIN best b ON b.c = convs.c AND b.i = 1 AND b.s = 0
"""
ORACLES: dict[str, str] = {
    "op4_sharding": _op4_sql(),
    "op7_line_dedup": _OP7,
    "op11_spelling_variants": _OP11,
    "op12_conversation_repair": _OP12,
    "op8_url_filters": duckdb_sql(RULES, "SELECT doc_id AS key, toxic = 1 AS bad FROM labels"),
}
