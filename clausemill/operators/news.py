"""Story payloads to digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.functions import text as tx


def payload_rows(df: DataFrame, text: str = "text", schema: str = schemas.STORY) -> DataFrame:
    """One row per record of embedded payloads: preamble, then an object whose data, stories or results is the list.

    The first of the three that is there and not empty decides; if it is no list, or the JSON is bad or followed by
    other text, the payload gives nothing.  Adds pos and story.
    """
    body = tx.json_tail(F.col(text))
    part = lambda k: F.get_json_object(body, f"$.{k}")
    there = lambda x: x.isNotNull() & ~x.isin("", "[]", "{}", "0", "false", "null")
    chosen = F.coalesce(*(F.when(there(part(k)), part(k)) for k in ("data", "stories", "results")))
    rows = F.when(chosen.startswith("["), F.from_json(chosen, f"array<struct<{_typed(schema)}>>"))
    return df.select(*(c for c in df.columns if c != text), F.posexplode(rows).alias("pos", "story"))


def _typed(schema: str) -> str:
    """DDL of columns as DDL of struct fields."""
    out, depth = [], 0
    for part in schema.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
        depth += 1
    return ",".join(out)


def region(geo: Column) -> Column:
    """First of country, region, admin1, location that is there, else Unknown."""
    return F.coalesce(*(F.nullif(geo.getField(k), F.lit("")) for k in ("country", "region", "admin1", "location")), F.lit("Unknown"))


def compact(stories: DataFrame, story: str = "story") -> DataFrame:
    """title, story_date, significance, country, sources (domains of the articles) of each story, beside its other columns."""
    s = F.col(story)
    domains = F.filter(F.transform(s["top_articles"], lambda a: a["domain"]), lambda d: F.coalesce(d, F.lit("")) != "")
    return stories.select(*(c for c in stories.columns if c != story), s["title"].alias("title"), s["story_date"].alias("story_date"), s["metrics"]["significance"].alias("significance"), s["geo"]["country"].alias("country"), F.coalesce(domains, F.array().cast("array<string>")).alias("sources"))


def first_articles(stories: DataFrame, keys: list[str], story: str = "story") -> DataFrame:
    """Articles of each story with different URLs, the first of each: keys, pos, title, url, domain."""
    x = stories.select(*keys, F.posexplode(F.col(story)["top_articles"]).alias("pos", "a")).filter("coalesce(a.url, '') <> ''")
    first = Window.partitionBy(*keys, "a.url").orderBy("pos")
    return x.withColumn("k", F.row_number().over(first)).filter("k = 1").select(*keys, "pos", F.coalesce("a.title", F.lit("")).alias("title"), "a.url", F.coalesce("a.domain", F.lit("")).alias("domain"))


def story_lines(stories: DataFrame, story: str = "story") -> DataFrame:
    """Adds line: a story and its articles as Markdown."""
    s = F.col(story)
    url, date, score = F.nullif(s["url"], F.lit("")), F.nullif(s["story_date"], F.lit("")), s["metrics"]["significance"]
    meta = F.nullif(F.concat_ws(", ", date, F.concat(F.lit("significance "), score.cast("string"))), F.lit(""))
    head = F.concat(F.lit("- **"), tx.present(s["title"], F.lit("(untitled)")), F.lit("**"), F.coalesce(F.concat(F.lit(" ([story]("), url, F.lit("))")), F.lit("")), F.coalesce(F.concat(F.lit(" — "), meta), F.lit("")))
    articles = F.filter(s["top_articles"], lambda a: F.coalesce(a["url"], F.lit("")) != "")
    urls = F.transform(articles, lambda a: a["url"])
    once = F.filter(F.transform(articles, lambda a, k: F.struct(a.alias("a"), (F.array_position(urls, a["url"]) == k + 1).alias("new"))), lambda x: x["new"])
    below = F.transform(once, lambda x: F.concat(F.lit("  - ["), F.coalesce(x["a"]["title"], F.lit("")), F.lit("]("), x["a"]["url"], F.lit(") ("), F.coalesce(x["a"]["domain"], F.lit("")), F.lit(")")))
    return stories.withColumn("line", F.concat_ws("\n", F.concat(F.array(head), F.coalesce(below, F.array().cast("array<string>")))))


def by_region(stories: DataFrame, keys: list[str], story: str = "story", order: str = "pos") -> DataFrame:
    """keys, region, n, lines: the stories of a region in order of arrival."""
    x = story_lines(stories, story).withColumn("region", region(F.col(story)["geo"]))
    return x.groupBy(*keys, "region").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda y: y["line"]), "\n").alias("lines"))


def digest(stories: DataFrame, topics: DataFrame, summarizer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """topic, markdown: regions in order.  stories: topic, pos, story.  summarizer: compact stories -> topic, summary."""
    regions = by_region(stories, ["topic"])
    body = regions.groupBy("topic").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "lines"))), lambda x: F.concat(F.lit("### "), x["region"], F.lit("\n"), x["lines"])), "\n").alias("body"))
    x = topics.select(F.col("name").alias("topic"), "query").join(body, "topic", "left")
    if summarizer is not None:
        x = x.join(summarizer(compact(stories)), "topic", "left")
    else:
        x = x.withColumn("summary", F.lit(None).cast("string"))
    n = F.coalesce("n", F.lit(0))
    empty = F.lit("_No stories returned or response shape did not match expected fields — see JSON output for raw content._")
    text = F.concat(F.lit("## "), F.col("topic"), F.lit("\n_Query: "), F.col("query"), F.lit("_  \n_"), n.cast("string"), F.lit(" stories_\n\n"), F.coalesce("summary", F.when(n == 0, "No stories were returned for this topic.").otherwise("")), F.lit("\n\n"), F.coalesce("body", empty), F.lit("\n"))
    return x.select("topic", text.alias("markdown"))


def recent_top(rows: DataFrame, when: str, days: int, limit: int, sort: str = "significance", score: str = "significance", tie: str | None = None) -> DataFrame:
    """Rows of the last `days` days before the latest, the best `limit` by score or by date."""
    latest = rows.agg(F.max(when).alias("latest")).scalar()
    order = [F.desc(score if sort == "significance" else when)] + ([tie] if tie else [])
    return rows.filter(F.col(when) >= latest - F.expr(f"INTERVAL {int(days)} DAYS")).orderBy(*order).limit(limit)
