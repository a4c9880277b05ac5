"""Queries over story payloads, listings, links and crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import news, web
from clausemill.queries.base import table


def json_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties wrapped in payloads: good, without an object, followed by text, with the list elsewhere."""
    k = F.col("event_id") % 5
    record = F.concat(F.lit('[{"title":"'), "event_type", F.lit('","geo":{"country":"'), F.when(k == 1, "").otherwise(F.col("user_id").cast("string")), F.lit('"}}]'))
    text = F.when(k == 0, F.concat(F.lit("Found: "), F.lit('{"data":'), record, F.lit("}"))).when(k == 1, F.concat(F.lit('{"data":[],"stories":'), record, F.lit("}"))).when(k == 2, F.concat(F.lit('{"data":'), record, F.lit("} trailing"))).when(k == 3, F.lit("nothing here")).otherwise(F.col("props"))
    rows = news.payload_rows(table(spark, sf_dir, "events").select("event_id", text.alias("text")))
    return rows.select("event_id", "pos", "story.title", news.region(F.col("story.geo")).alias("region"))


def region_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stories by the first known place."""
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise("").alias("country"), F.when(F.col("c_custkey") % 3 == 0, F.col("r_name")).alias("region"), F.when(F.col("c_custkey") % 5 == 0, F.lit("A")).alias("admin1"), F.lit(None).cast("string").alias("location"))
    return x.select("c_mktsegment", "c_custkey", news.region(geo).alias("region")).groupBy("c_mktsegment", "region").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("c_custkey")), 1, 3), lambda v: v.cast("string")), ",").alias("first"))


def first_url_per_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page as articles: each URL once, at its first place."""
    articles = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1), lambda u: F.struct(F.lit("t").alias("title"), F.when(u == "#", "").otherwise(u).alias("url"), F.lit("d").alias("domain")))
    stories = table(spark, sf_dir, "pages").select("page_id", F.struct(articles.alias("top_articles")).alias("story"))
    return news.first_articles(stories, ["page_id"]).select("page_id", "pos", "url")


def recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return news.recent_top(events, "ts", 5, 25, "significance", "value", "event_id").select("event_id", "value")


def recent_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return news.recent_top(events, "ts", 5, 25, "date", "value", "event_id").select("event_id", "value")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    return web.forward_fill(x, "value", ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "value")


def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.first_links(web.link_rows(table(spark, sf_dir, "pages"), "page_id"), "page_id").select("page_id", "pos", "href")


def _followed(url: Column) -> Column:
    return web.is_crawlable(url, "example", ["the", "and", "of", "to", "in", "der", "die", "le", "de"])


def crawl_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and what they link to."""
    pages = table(spark, sf_dir, "pages").withColumn("base", F.lit("http://site.example/"))
    links = web.absolute_links(web.link_rows(pages, ["url", "base"]), "base")
    seeds = pages.select("url", F.col("page_id").alias("pos"))
    return web.crawl(seeds, links, pages, None, _followed).select("level", "parent", "url", F.col("html").isNotNull().alias("found"))


def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages wrapped in the layout of a detail page, and parsed."""
    head = F.concat(F.lit('<table class="tablebg"><tr><td class="tableheader"><b>Page '), "page_id", F.lit('</b></td></tr><tr><td class="tableheader">Date : 1 May</td></tr><tr class="tablecontent2"><td><table class="td"><tr><td>'))
    html = F.concat(head, "html", F.lit("</td></tr></table></td></tr></table>"))
    out = web.details(table(spark, sf_dir, "pages").select("url", html.alias("html")))
    return out.select("url", "title", "date", F.size("linked_documents").alias("n_links"), F.length("body_text").alias("n_chars"), "error")


def classification_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.concat(F.lit("a|"), "n_name").alias("title"), F.col("n_nationkey").alias("key"))
    return web.classification_table(items, ["title", "key"], ["key"])


def story_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stories, a nation's as a topic, listed by region of the story."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda x: x.cast("string")
    article = F.array(F.struct(F.lit("a").alias("title"), F.lit("u1").alias("url"), F.lit("d").alias("domain")), F.struct(F.lit("b").alias("title"), F.lit("u1").alias("url"), F.lit("d").alias("domain")))
    geo = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("country"), *(text(F.lit(None)).alias(x) for x in ("region", "admin1", "location")))
    story = F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("u"), "c_custkey")).alias("url"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-01")).alias("story_date"), F.struct(F.lit(None).cast("double").alias("significance")).alias("metrics"), geo.alias("geo"), article.alias("top_articles"))
    topics = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("q").alias("query"))
    return news.digest(c.select(F.col("n_name").alias("topic"), F.col("c_custkey").alias("pos"), story.alias("story")), topics).select("topic", F.md5("markdown").alias("digest"), F.length("markdown").alias("n_chars"))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose last path part no document id has, once for each name."""
    wanted = table(spark, sf_dir, "pages").select(F.col("url").alias("pdf_url"))
    stored = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).cast("string").alias("file_name"))
    return web.missing_files(wanted, stored).select("file_name")


QUERIES = {f.__name__: f for f in (story_digest, missing_files, json_payload_extract, region_group, first_url_per_story, recent_topn, recent_by_date, forward_fill, links_extract, crawl_two_level, page_parse, classification_table)}

_HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_LINKS = f"u AS (SELECT page_id, url, unnest({_HREF}) AS href, unnest(range(len({_HREF}))) AS pos FROM pages), f AS (SELECT page_id, url, min(pos)::INTEGER AS pos, trim(href) AS href FROM u WHERE trim(href) <> '' AND NOT prefix(trim(href), '#') GROUP BY page_id, url, trim(href))"
_FILE = "coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), ''), md5(url) || '.pdf')"
ORACLES = {
    "story_digest": """WITH s AS (SELECT n_name AS topic, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS region, '- **' || CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '(untitled)' END || '**' || CASE WHEN c_custkey % 5 <> 0 THEN ' ([story](u' || c_custkey || '))' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ' — 2024-01-01' ELSE '' END || chr(10) || '  - [a](u1) (d)' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT topic, region, count(*) AS n, '### ' || region || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS part FROM s GROUP BY topic, region),
b AS (SELECT topic, sum(n) AS n, string_agg(part, chr(10) ORDER BY region) AS body FROM g GROUP BY topic),
m AS (SELECT n_name AS topic, '## ' || n_name || chr(10) || '_Query: q_  ' || chr(10) || '_' || coalesce(n, 0) || ' stories_' || chr(10) || chr(10) || CASE WHEN n IS NULL THEN 'No stories were returned for this topic.' ELSE '' END || chr(10) || chr(10) || coalesce(body, '_No stories returned or response shape did not match expected fields — see JSON output for raw content._') || chr(10) AS markdown FROM nation LEFT JOIN b ON n_name = topic)
SELECT topic, md5(markdown) AS digest, length(markdown)::INTEGER AS n_chars FROM m""",
    "missing_files": f"SELECT DISTINCT {_FILE} AS file_name FROM pages WHERE {_FILE} NOT IN (SELECT (doc_id * 3)::VARCHAR FROM documents)",
    "json_payload_extract": "SELECT event_id, 0 AS pos, event_type AS title, CASE WHEN event_id % 5 = 1 THEN 'Unknown' ELSE user_id::VARCHAR END AS region FROM events WHERE event_id % 5 IN (0, 1)",
    "region_group": "WITH x AS (SELECT c_mktsegment, c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN n_name END, CASE WHEN c_custkey % 3 = 0 THEN r_name END, CASE WHEN c_custkey % 5 = 0 THEN 'A' END, 'Unknown') AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_mktsegment, region, count(*) AS n, array_to_string(list_sort(list(c_custkey))[1:3], ',') AS first FROM x GROUP BY ALL",
    "first_url_per_story": f"WITH u AS (SELECT page_id, unnest({_HREF}) AS url, unnest(range(len({_HREF}))) AS pos FROM pages) SELECT page_id, min(pos)::INTEGER AS pos, url FROM u WHERE url NOT IN ('', '#') GROUP BY page_id, url",
    "recent_topn": "SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS ORDER BY value DESC, event_id LIMIT 25",
    "recent_by_date": "SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS ORDER BY ts DESC, event_id LIMIT 25",
    "forward_fill": "SELECT user_id, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events",
    "links_extract": f"WITH {_LINKS} SELECT page_id, pos, href FROM f",
    "crawl_two_level": f"""WITH {_LINKS}, s AS (SELECT url FROM pages), l AS (SELECT DISTINCT f.url AS parent, CASE WHEN prefix(href, '/') THEN 'http://site.example' || href ELSE href END AS url FROM f WHERE (prefix(href, '/') OR contains(regexp_extract(href, '://([^/]*)', 1), 'example')) AND lower(regexp_extract(href, '([^/]*)$', 1)) IN ('the', 'and', 'of', 'to', 'in', 'der', 'die', 'le', 'de')),
w AS (SELECT 1 AS level, NULL AS parent, url FROM s UNION ALL SELECT 2, parent, url FROM l) SELECT level, parent, url, url IN (SELECT url FROM pages WHERE html IS NOT NULL) AS found FROM w""",
    "classification_table": "WITH x AS (SELECT r_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k, n_nationkey AS key, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT name, '| # | title | key |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || k || ' | a\\|' || n_name || ' | ' || key || ' |', chr(10) ORDER BY k) AS markdown FROM x GROUP BY name",
}
