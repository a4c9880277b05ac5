"""Lines to headings, sections and a tree kept as parent ordinals.

All order-dependent steps are windows over (stem, line or event order).  With `segment` they run in two levels (scan.running), and one
huge document is split over tasks; without it a document is the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.scan import running

PAGE_MARK = r"^<!--\s*Page\s+(\d+)\s*-->$"
HEADING_MARK = r"^##\s+(.*)$"
LEVELS = ["part", "section", "subsection", "clause", "annex", "table", "footnote"]
#: Deepest rank that the parent search keeps apart: a subsection with ten dots.
MAX_RANK = 12
_CLAUSE_RANK = 1001


def mark_lines(lines: DataFrame, order: str = "line_no", raw: str = "raw", stem: str = "stem", segment: int | None = None) -> DataFrame:
    """Adds page (running number, 1 before the first mark), is_page, heading (null where none) and event (0 before the first heading)."""
    mark = F.nullif(F.regexp_extract(tx.trim(F.col(raw)), PAGE_MARK, 1), F.lit("")).cast("int")
    heading = F.when(F.col(raw).rlike(HEADING_MARK) & mark.isNull(), tx.trim(F.regexp_extract(F.col(raw), HEADING_MARK, 1)))
    x = lines.withColumns({"mark": mark, "heading": heading})
    x = running(x, [stem], order, {"page": ("last", F.col("mark")), "event": ("sum", F.when(F.col("heading").isNotNull(), 1))}, segment=segment)
    return x.withColumns({"page": F.coalesce("page", F.lit(1)), "event": F.col("event").cast("long"), "is_page": F.col("mark").isNotNull()}).drop("mark")


def heading_events(marked: DataFrame, order: str = "line_no", raw: str = "raw", stem: str = "stem") -> DataFrame:
    """One row per heading: raw_heading, classified (null if no pattern fits), page_start, page_end, body (one text).

    Lines before the first heading are left out.  page_end is the page of the last line, blank ones included.
    """
    line = tx.trim(F.col(raw))
    own = ~F.col("is_page") & F.col("heading").isNull()
    body = F.array_sort(F.collect_list(F.when(own & (line != ""), F.struct(F.col(order).alias("o"), line.alias("l")))))
    grouped = marked.filter("event > 0").groupBy(stem, F.col("event").alias("ord")).agg(
        F.max("heading").alias("raw_heading"),
        F.min(F.when(F.col("heading").isNotNull(), F.col("page"))).alias("page_start"),
        F.max_by("page", F.when(own, F.col(order))).alias("last_page"),
        F.nullif(F.array_join(F.transform(body, lambda x: x["l"]), "\n"), F.lit("")).alias("body"),
    )
    # the explode of one element keeps the optimizer from copying the cascade into every use of its fields
    once = F.explode(F.array(tx.classify_heading(F.col("raw_heading")))).alias("classified")
    return grouped.select(stem, "ord", "raw_heading", once, "page_start", F.coalesce("last_page", "page_start").alias("page_end"), "body")


def ambiguous(events: DataFrame, stem: str = "stem") -> DataFrame:
    """Headings without a pattern, with what a level hook gets: prev_type (null if that one is ambiguous too) and following_text."""
    order = Window.partitionBy(stem).orderBy("ord")
    x = events.withColumn("prev_type", F.lag("classified.type").over(order)).filter("classified IS NULL")
    return x.select(stem, "ord", F.col("raw_heading"), "prev_type", F.substring(F.translate(F.coalesce("body", F.lit("")), "\n", " "), 1, 150).alias("following_text"))


def resolve(events: DataFrame, level_hook: Callable[[DataFrame], DataFrame] | None = None, stem: str = "stem") -> DataFrame:
    """Give every heading a class.  level_hook: ambiguous(...) -> (stem, ord, level); unknown or missing levels are clauses."""
    if level_hook is None:
        level = F.lit("clause")
    else:
        levels = level_hook(ambiguous(events, stem)).groupBy(stem, "ord").agg(F.last("level").alias("level"))
        events = events.join(levels, [stem, "ord"], "left")
        level = F.when(F.col("level").isin(LEVELS), F.col("level")).otherwise("clause")
    none = F.lit(None).cast("string")
    default = F.struct(level.alias("type"), none.alias("number"), none.alias("title"), F.col("raw_heading").alias("text"))
    return events.withColumn("classified", F.coalesce("classified", default)).drop("level")


def rank(kind: Column, number: Column) -> Column:
    """Depth of what can hold others (null for tables and footnotes)."""
    dots = F.length(F.regexp_replace(F.coalesce(number, F.lit("")), "[^.]", ""))
    deep = F.least(F.greatest(dots, F.lit(1)) + 2, F.lit(MAX_RANK))
    return F.when(kind.isin("part", "annex"), 1).when(kind == "section", 2).when(kind == "subsection", deep).when(kind == "clause", _CLAUSE_RANK)


def assign_parents(nodes: DataFrame, order: str = "ord", stem: str = "stem", kind: str = "type", number: str = "number", segment: int | None = None) -> DataFrame:
    """Adds parent_ord: the nearest earlier holder of smaller rank that no holder in between closes; null at the top.

    One window holds, for each rank, the last ordinal seen; a part or annex closes all before it.
    """
    own = F.col("__rank")
    ranked = nodes.withColumn("__rank", rank(F.col(kind), F.col(number)))
    levels = [*range(1, MAX_RANK + 1), _CLAUSE_RANK]
    seen = running(ranked, [stem], order, {f"__r{k}": ("last", F.when(own == k, F.col(order))) for k in levels}, inclusive=False, segment=segment)
    limit = F.coalesce(own, F.lit(_CLAUSE_RANK + 1))
    parent = F.greatest(*(F.when(F.lit(k) < limit, F.col(f"__r{k}")) for k in levels))
    top = F.col(kind).isin("part", "annex")
    return seen.select(*nodes.columns, F.when(~top, parent).alias("parent_ord"))


def build_nodes(events: DataFrame, stem: str = "stem", segment: int | None = None) -> DataFrame:
    """Tree rows of classified headings.  Clauses, tables and footnotes keep their own text if they have one; the others take the body."""
    x = events.select(stem, "ord", "classified.type", "classified.number", F.col("classified.title").alias("heading"), F.when(F.col("classified.type").isin("clause", "table", "footnote"), tx.present("classified.text", "body")).otherwise(F.col("body")).alias("text"), "page_start", "page_end")
    return assign_parents(x, stem=stem, segment=segment).select(stem, "ord", "parent_ord", "type", "number", "heading", "text", "page_start", "page_end")


def build_structure(lines: DataFrame, level_hook: Callable[[DataFrame], DataFrame] | None = None, segment: int | None = None) -> DataFrame:
    """Markdown lines (stem, line_no, raw) -> tree rows."""
    return build_nodes(resolve(heading_events(mark_lines(lines, segment=segment)), level_hook), segment=segment)


def leaves(nodes: DataFrame, stem: str = "stem", order: str = "ord") -> DataFrame:
    """Nodes without children."""
    parents = nodes.filter("parent_ord IS NOT NULL").select(F.col(stem).alias("__s"), F.col("parent_ord").alias("__p")).distinct()
    return nodes.join(parents, (F.col(stem) == F.col("__s")) & (F.col(order) == F.col("__p")), "left_anti")


def operative_units(nodes: DataFrame, stem: str = "stem", order: str = "ord") -> DataFrame:
    """Nodes with text of their own that bind: clauses, leaves, and numbered sections and subsections."""
    parents = nodes.filter("parent_ord IS NOT NULL").select(F.col(stem).alias("__s"), F.col("parent_ord").alias("__p")).distinct()
    x = nodes.join(parents, (F.col(stem) == F.col("__s")) & (F.col(order) == F.col("__p")), "left")
    numbered = F.col("type").isin("section", "subsection") & (F.coalesce("number", F.lit("")) != "")
    return x.filter(((F.col("type") == "clause") | F.col("__p").isNull() | numbered) & (F.coalesce("text", F.lit("")) != "")).drop("__s", "__p")


def trails(nodes: DataFrame, stem: str = "stem", order: str = "ord", depth: int = MAX_RANK + 1, segment: int | None = None) -> DataFrame:
    """Adds trail: the titles above a node joined by ' > ', or '(document root)'.

    One window keeps the latest open title of each rank, as for parents, so no join follows the tree upwards.
    """
    del depth
    entry = F.trim(F.concat("type", F.lit(" "), F.coalesce("number", F.lit("")), F.lit(" "), F.coalesce("heading", F.lit(""))))
    levels = [*range(1, MAX_RANK + 1), _CLAUSE_RANK]
    ranked = nodes.withColumns({"__rank": rank(F.col("type"), F.col("number")), "__entry": entry})
    pick = lambda k: F.when(F.col("__rank") == k, F.struct(F.col(order).alias("o"), F.lit(k).alias("k"), F.col("__entry").alias("e")))
    seen = running(ranked, [stem], order, {f"__r{k}": ("last", pick(k)) for k in levels}, inclusive=False, segment=segment)
    limit = F.coalesce("__rank", F.lit(_CLAUSE_RANK + 1))
    open_ = F.filter(F.array(*(F.when(F.lit(k) < limit, F.col(f"__r{k}")) for k in levels)), lambda x: x.isNotNull())
    open_ = F.when(F.col("type").isin("part", "annex"), F.array().cast("array<struct<o:bigint,k:int,e:string>>")).otherwise(open_.cast("array<struct<o:bigint,k:int,e:string>>"))
    # an entry is open if nothing of its rank or above came after it
    real = F.filter("__open", lambda x: ~F.exists("__open", lambda y: (y["o"] > x["o"]) & (y["k"] <= x["k"])))
    seen = seen.withColumn("__open", open_)
    text = F.array_join(F.transform(F.array_sort(real), lambda x: x["e"]), " > ")
    return seen.select(*nodes.columns, F.coalesce(F.nullif(text, F.lit("")), F.lit("(document root)")).alias("trail"))
