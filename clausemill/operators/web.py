"""Listings and detail pages of a regulator's site; crawling two levels deep over a table of pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.functions.python import absolute_url
from clausemill.sources.decoders import text_pages

# Pages that are followed, by the last part of their path in lower case, and the site's domain.
CRAWLABLE = ["notificationuser.aspx", "bs_pressreleasedisplay.aspx", "bs_viewmasdirections.aspx", "bs_speechesview.aspx", "publicationsview.aspx"]
SITE = "rbi.org.in"


def is_crawlable(url: Column, domain: str = SITE, names: list[str] | None = None) -> Column:
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.contains(host, F.lit(domain)) & F.lower(F.element_at(F.split(path, "/"), -1)).isin(names or CRAWLABLE), F.lit(False))


def link_rows(pages: DataFrame, key: str | list[str], html: str = "html") -> DataFrame:
    """key, pos, href: values of href attributes in order, however they are quoted, without empty ones and fragments."""
    keys = [key] if isinstance(key, str) else key
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)(?<=[\s"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    href = F.trim(F.regexp_replace("href", "^[\"']|[\"']$", ""))
    return pages.select(*keys, F.posexplode(found).alias("pos", "href")).withColumn("href", href).filter("href <> '' AND NOT startswith(href, '#')")


def first_links(links: DataFrame, key: str, url: str = "href") -> DataFrame:
    """Each URL of a page once, at its first place."""
    turn = F.row_number().over(Window.partitionBy(key, url).orderBy("pos"))
    return links.withColumn("__k", turn).filter("__k = 1").drop("__k")


def absolute_links(links: DataFrame, base: str, href: str = "href", key: str = "url") -> DataFrame:
    """Links as absolute URLs, each of a page once."""
    return first_links(links.withColumn(href, absolute_url(F.col(base), F.col(href))), key, href)


def crawl(seeds: DataFrame, links: DataFrame, pages: DataFrame, limit: int | None = None, followed: Callable[[Column], Column] = is_crawlable) -> DataFrame:
    """level, parent, url, html: the first `limit` seeds (url, pos), and the pages they link to that are followed, each fetched once.

    links: url, href (absolute).  pages: url, html.  A URL without a page has null html.  Level 2 is not followed on.
    """
    top = seeds.orderBy("pos").limit(limit) if limit is not None else seeds
    first = top.select(F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), "url")
    second = first.select(F.col("url").alias("parent")).distinct().join(links.select(F.col("url").alias("parent"), F.col("href").alias("url")).distinct(), "parent").filter(followed(F.col("url"))).select(F.lit(2).alias("level"), "parent", "url")
    wanted = first.unionByName(second)
    fetched = wanted.select("url").distinct().join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left")
    return wanted.join(fetched, "url", "left").select("level", "parent", "url", "html")


def forward_fill(rows: DataFrame, column: str, order: list[str], by: list[str]) -> DataFrame:
    """The column with nulls replaced by the last value before them."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(run))


def listing(pages: DataFrame) -> DataFrame:
    """url, pos, title, link: entries of listing pages (url, html)."""
    from clausemill.sources.html import listing_items

    return _parsed(pages, listing_items, "pos int, title string, link string")


def details(pages: DataFrame) -> DataFrame:
    """Detail pages (url, html) parsed: schemas.SCRAPED."""
    from clausemill.sources.html import detail_page

    names = [f.split(" ")[0] for f in "title string, date string, pdf_url string, pdf_size string, body_text string, linked_documents x, error string".split(", ")]

    def run(frames):
        for pdf in frames:
            found = [detail_page(u, h or "") for u, h in zip(pdf["url"], pdf["html"], strict=True)]
            yield pd.DataFrame({"url": pdf["url"], **{n: [x[n] for x in found] for n in names}})

    return pages.select("url", "html").mapInPandas(run, schemas.SCRAPED)


def notifications(pages: DataFrame) -> DataFrame:
    """url, pos, date, title, pdf_url, pdf_size: rows of notification listings, dates carried forward."""
    from clausemill.sources.html import notification_rows

    rows = _parsed(pages, notification_rows, "pos int, date string, title string, pdf_url string, pdf_size string")
    return forward_fill(rows, "date", ["pos"], ["url"]).filter("title IS NOT NULL AND pdf_url IS NOT NULL")


def _parsed(pages: DataFrame, parse: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = ["url", *(x.split(" ")[0] for x in schema.split(", "))]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(u, *row) for u, h in zip(pdf["url"], pdf["html"], strict=True) for row in parse(u, h or "")], columns=names)

    return pages.select("url", "html").mapInPandas(run, f"url string, {schema}")


def _file_names(wanted: DataFrame, url: str, name: str) -> DataFrame:
    """Adds the last part of a URL's path, or a name made of the URL's hash where that is empty."""
    last = F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)
    return wanted.withColumn(name, F.coalesce(F.nullif(last, F.lit("")), F.concat(F.md5(url), F.lit(".pdf"))))


def missing_files(wanted: DataFrame, stored: DataFrame, url: str = "pdf_url", name: str = "file_name") -> DataFrame:
    """URLs whose file name (the last part of their path) is not stored yet.  URLs with equal names share one file."""
    return _file_names(wanted, url, name).join(stored.select(name).distinct(), name, "left_anti").dropDuplicates([name])


def stored_files(path: str, wanted: DataFrame, fetcher: Callable[[str], bytes | None], decoder: Callable[[bytes], list[str]] = text_pages) -> DataFrame:
    """wanted (pdf_url, ...) with file_name, content and pdf_text; what the store at `path` lacks is fetched once and added to it.

    A file that cannot be fetched is not stored and is tried again next time; one that cannot be decoded has no text.
    """
    spark, schema = wanted.sparkSession, "file_name string, content binary"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)

    def fetch(frames):
        for pdf in frames:
            rows = []
            for name, url in zip(pdf["file_name"], pdf["pdf_url"], strict=True):
                try:
                    content = fetcher(url)
                except Exception:  # noqa: BLE001  a file that fails stays missing
                    content = None
                if content is not None:
                    rows.append((name, content))
            yield pd.DataFrame(rows, columns=["file_name", "content"])

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        out = []
        for content in contents:
            try:
                out.append("\n\n".join(x for x in decoder(bytes(content)) if x) or None if content is not None else None)
            except Exception:  # noqa: BLE001  a file that is not readable has no text
                out.append(None)
        return pd.Series(out, dtype=object)

    missing_files(wanted.filter("pdf_url IS NOT NULL"), stored).select("file_name", "pdf_url").mapInPandas(fetch, schema).write.mode("append").parquet(path)
    kept = spark.read.schema(schema).parquet(path).dropDuplicates(["file_name"])
    return _file_names(wanted, "pdf_url", "file_name").join(kept.withColumn("pdf_text", text("content")), "file_name", "left")


def contents(details: DataFrame, by: str, order: str = "url") -> DataFrame:
    """by, markdown: a list of the titles of a digest's pages, in order."""
    title = F.coalesce(F.nullif("title", F.lit("")), "url")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), title.alias("t"))))
    line = F.array_join(F.transform(rows, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["t"])), "\n")
    return details.groupBy(by).agg(F.concat(F.lit("# Contents\n\n"), line, F.lit("\n")).alias("markdown"))


def scrape_digest(details: DataFrame) -> DataFrame:
    """url, markdown: a scraped page as a section: title, facts that are there, body, linked documents."""
    fact = lambda name, c: F.concat(F.lit(f"- {name}: "), F.nullif(F.col(c), F.lit("")))
    links = F.array_join(F.transform("linked_documents", lambda x: F.concat(F.lit("- ["), F.coalesce(F.nullif(x["text"], F.lit("")), x["url"]), F.lit("]("), x["url"], F.lit(")"))), "\n")
    parts = [F.concat(F.lit("## "), F.coalesce(F.nullif("title", F.lit("")), "url")), F.concat_ws("\n", fact("URL", "url"), fact("Date", "date"), fact("File", "pdf_url"), fact("Size", "pdf_size"), fact("Error", "error")), F.nullif("body_text", F.lit("")), F.nullif(links, F.lit(""))]
    return details.select("url", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))


def classification_table(items: DataFrame, columns: list[str], order: list[str], name: str = "name") -> DataFrame:
    """name, markdown: a table of items with numbered rows; bars in cells are escaped.  Missing columns are an error."""
    missing = [c for c in columns if c not in items.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    turn = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("__n").cast("string"), *(cell(c) for c in columns)), F.lit(" |"))
    head = F.lit(f"| # | {' | '.join(columns)} |\n|{'---|' * (len(columns) + 1)}")
    rows = items.withColumn("__n", turn).select(name, "__n", line.alias("line"))
    return rows.groupBy(name).agg(F.concat(head, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "line"))), lambda x: x["line"]), "\n")).alias("markdown"))
