"""Page text to clean markdown lines and document statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.functions import text as tx
from clausemill.operators.scan import running


def split_lines(df: DataFrame, text: str = "text", out: str = "raw", position: str = "line_no") -> DataFrame:
    """One row per line (any Unicode line break; nothing after a break at the end): adds position from 0, and the line."""
    body = F.regexp_replace(F.col(text), f"({tx.LINE_BREAK})$", "")
    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, tx.LINE_BREAK))
    return df.select(*(c for c in df.columns if c != text), F.posexplode(lines).alias(position, out))


def _words(line: str) -> Column:
    return F.filter(F.split(tx.trim(F.col(line)), r"(?U)\s+"), lambda w: w != "")


def _kept(line: str) -> Column:
    return F.filter(_words(line), lambda w: w.rlike(rf"^{tx.PLAIN}$") | tx.is_clean_token(w))


def denoise_lines(lines: DataFrame, line: str = "raw") -> DataFrame:
    """Lines of clean tokens only; blank lines stay, lines of garbage alone go.  Tokens are judged only in lines that hold a doubtful one."""
    text = F.when(tx.has_other_token(F.col(line)), F.array_join(_kept(line), " ")).otherwise(F.regexp_replace(tx.trim(F.col(line)), r"(?U)\s+", " "))
    x = lines.withColumn("__clean", text)
    return x.filter((F.col("__clean") != "") | (tx.trim(F.col(line)) == "")).withColumn(line, F.col("__clean")).drop("__clean")


def denoise_stats(lines: DataFrame, by: list[str], line: str = "raw") -> DataFrame:
    """lines_in, lines_dropped, tokens_in, tokens_dropped.

    Tokens are counted by group first, and each different one is judged once; a line is judged whole only if it has no
    plain token.
    """
    # the filter runs inside code generation, after the explode
    tokens = lines.select(*by, F.explode(F.split(F.col(line), r"(?U)\s+")).alias("__token")).filter("__token <> ''").groupBy(*by, "__token").agg(F.count("*").alias("__n"))
    judged = tokens.select(*by, F.lit(0).alias("l"), F.lit(0).alias("d"), F.col("__n").alias("t"), F.when(tx.is_clean_token(F.col("__token")), 0).otherwise(F.col("__n")).alias("x"))
    gone = F.when(tx.has_plain_token(F.col(line)) | (tx.trim(F.col(line)) == ""), 0).otherwise(F.when(F.size(_kept(line)) == 0, 1).otherwise(0))
    whole = lines.select(*by, F.lit(1).alias("l"), gone.alias("d"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("x"))
    return judged.unionByName(whole).groupBy(*by).agg(*(F.sum(c).alias(name) for c, name in (("l", "lines_in"), ("d", "lines_dropped"), ("t", "tokens_in"), ("x", "tokens_dropped"))))


def denoise_pages(pages: DataFrame) -> DataFrame:
    """pages (stem, page_no, text) with clean text."""
    lines = denoise_lines(split_lines(pages))
    own = lines.groupBy("stem", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return pages.select("stem", "page_no").join(own, ["stem", "page_no"], "left").select("stem", "page_no", F.coalesce("text", F.lit("")).alias("text"))


def likely_scanned(pages: DataFrame, per_page: int = 200) -> DataFrame:
    """stem, n_pages, n_chars (pages joined by two line ends), scanned: fewer than per_page characters a page."""
    x = pages.groupBy("stem").agg(F.count("*").alias("n_pages"), (F.sum(F.length(F.coalesce("text", F.lit("")))) + 2 * (F.count("*") - 1)).alias("n_chars"))
    return x.withColumn("scanned", F.col("n_chars") < F.col("n_pages") * per_page)


def markdown_lines(pages: DataFrame) -> DataFrame:
    """stem, line_no, raw: page marks, headings as `## h` between blank lines, a blank line after each page."""
    lines = split_lines(pages)
    text = F.regexp_replace("raw", r"(?U)\s+$", "")
    body = F.when(tx.is_heading(text), F.array(F.lit(""), F.concat(F.lit("## "), tx.trim(text)), F.lit(""))).otherwise(F.array(text))
    rows = lines.select("stem", "page_no", F.col("line_no").cast("long").alias("at"), F.posexplode(body).alias("k", "raw"))
    first = pages.select("stem", "page_no", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("k"), F.concat(F.lit("<!-- Page "), F.col("page_no"), F.lit(" -->")).alias("raw"))
    last = pages.select("stem", "page_no", F.lit(2**62).alias("at"), F.lit(0).alias("k"), F.lit("").alias("raw"))
    order = Window.partitionBy("stem").orderBy("page_no", "at", "k")
    return rows.unionByName(first).unionByName(last).select("stem", (F.row_number().over(order) - 1).cast("long").alias("line_no"), "raw")


def markdown_text(lines: DataFrame) -> DataFrame:
    """stem, markdown, total_sections."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    return lines.groupBy("stem").agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("markdown"), F.count_if(F.col("raw").startswith("## ")).alias("total_sections"))


def document_stats(pages: DataFrame, images: str | None = None) -> DataFrame:
    """stem, total_pages, total_words, total_characters, total_images."""
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy("stem").agg(F.count("*").alias("total_pages"), F.sum(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))).alias("total_words"), (F.sum(F.length(text)) + 2 * (F.count("*") - 1)).alias("total_characters"), (F.sum(images) if images else F.lit(0)).cast("long").alias("total_images"))


def file_hash(content: str = "content"):
    return F.concat(F.lit("sha256:"), F.sha2(F.col(content).cast("binary"), 256))


def extraction_status(log: DataFrame) -> DataFrame:
    """stem, extraction_status: Success unless a step failed (skipped is no failure)."""
    return log.groupBy("stem").agg(F.when(F.bool_and(F.col("status") != "failed"), "Success").otherwise("Partial").alias("extraction_status"))


def first_chars(pages: DataFrame, max_chars: int, segment: int = 4096) -> DataFrame:
    """stem, text: the pages in order, joined by two line ends, cut after max_chars.

    Pages are placed by running lengths (scan.running, rows of a few numbers), and only those that begin, with the line ends before them, before the cut go on, each cut
    itself.  So a stem of any size is gathered up to max_chars and no further, and no shuffled row is longer than that.
    """
    sized = pages.select("stem", "page_no", (F.length(F.coalesce("text", F.lit(""))) + 2).cast("long").alias("size"))
    placed = running(sized, ["stem"], "page_no", {"at": ("sum", F.col("size"))}, inclusive=False, segment=segment).filter(F.col("at") < max_chars + 2)
    wanted = placed.select(F.col("stem").alias("__s"), F.col("page_no").alias("__p"), "at")
    cut = pages.select("stem", "page_no", F.substring(F.coalesce("text", F.lit("")), 1, max_chars).alias("text"))
    own = cut.join(wanted, F.col("stem").eqNullSafe(F.col("__s")) & F.col("page_no").eqNullSafe(F.col("__p"))).select("stem", "page_no", F.substring("text", F.lit(1), F.greatest(F.lit(max_chars) - F.col("at"), F.lit(0)).cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    return own.groupBy("stem").agg(F.substring(joined, 1, max_chars).alias("text"))


def metadata(pages: DataFrame, hook: Callable[[DataFrame], DataFrame] | None = None, overrides: dict[str, str] | None = None, images: str | None = None, max_chars: int = 60_000) -> DataFrame:
    """One row per document: hook fields (null without a hook), overrides where given, statistics.

    hook: (stem, text of at most max_chars for the model) -> stem and some of schemas.METADATA_FIELDS.
    """
    base = document_stats(pages, images)
    if hook is not None:
        base = base.join(hook(first_chars(pages, max_chars)), "stem", "left")
    for name in schemas.METADATA_FIELDS:
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("array<string>" if name in ("applicable_entities", "keywords_from_document") else "string"))
    for name, value in (overrides or {}).items():
        base = base.withColumn(name, F.coalesce(F.nullif(F.lit(value), F.lit("")), F.col(name)))
    status = F.lit("Success" if hook is None else None)
    return base.withColumns({"business_domain": F.coalesce(F.nullif("business_domain", F.lit("")), F.lit("Unknown")), "detected_language": F.col("language"), "document_format": F.lit("PDF"), "OCR_used": F.lit(False), "total_tables": F.lit(None).cast("int"), "extraction_status": F.coalesce(status, F.lit("Success"))})
