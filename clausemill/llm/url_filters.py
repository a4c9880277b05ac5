"""URL filters from rules, and from a tree of path templates where no rule fits.

Rules.  A rule is (verdict, "host/path"); it fits its host and all subdomains, if the URL's path starts with its path.
The longest rule that fits decides.  Rules are a short list given by the caller (at most 1,000).

Templates.  Pages are first counted by host and path.  In rounds, for each host and each branch of its tree:

* chains: segments that all paths of a branch have in common are taken at once, and a branch with one path is finished;
* segments: where a branch has over `max_children` different segments, those with less than 1 / max_children of the
  branch's pages become a wildcard, which keeps a file extension (`*.html`); rounds go on until
  no path has a further segment, or to `depth` if it is given: what lies below becomes `**`;
* merging: children whose rate of blocked labels does not differ from the branch's rate (within `z` standard errors)
  go on together as `~`; one comparison each with the pooled branch, no pairs.

A template is blocked if its purity, (blocked + weight x rate of its host) / (labelled + weight), reaches `limit`; the
host's rate is smoothed likewise by the rate of all pages.  Labels are the verdicts of rules and, for pages without
one, the caller's labels.

A round holds unfinished paths only, and there are as many rounds as places at which paths part one below another, however deep
the deepest path is.  All steps are aggregations (partial before each shuffle) and equi-joins.  Tables of branches are written before they are
joined back: up to `BRANCH_BYTES` they are broadcast, and beyond that both sides of the join are plain shuffles, so that
Spark's skew join splits the segments of a host with a third of all pages.  Pages never gather by host.

Defined cases: a null URL, or one without `://`, has host '' and path '' and fits no rule; null ids are kept;
repeated pages each get a row; null labels do not count; pages with several labels are blocked if one says so; without
any label all templates are allowed; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import settle

BRANCH_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """Of the longest rule that fits: its verdict (value 0) or text (1)."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, rule[value]) if out is None else out.when(fits, rule[value])
    return F.lit(None).cast("string") if out is None else out


def _side(df: DataFrame, name: str) -> DataFrame:
    """df as a table, broadcast if its keys take at most BRANCH_BYTES."""
    table = settle(df, name)
    size = table.agg(F.sum(sum((F.octet_length(c) + 24 for c in ("host", "branch") if c in df.columns), F.lit(24)))).first()[0] or 0
    return F.broadcast(table) if size <= BRANCH_BYTES else table


_AT = ["host", "branch"]


def _chains(nodes: DataFrame) -> DataFrame:
    """Nodes after the segments that all of their branch begin with; rest is empty where a path ends, or is the only one of its branch."""
    same = F.filter(F.sequence(F.lit(1), F.size("low")), lambda k: F.slice("low", 1, k) == F.slice("high", 1, k))
    skip = F.when(F.col("paths") == 1, F.size("low")).otherwise(F.size(same))
    ends = nodes.groupBy(*_AT).agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.count("*").alias("paths"))
    ahead = _side(ends.select(*_AT, skip.alias("skip")).filter("skip > 0"), "chains")
    x = nodes.join(ahead, _AT, "left").withColumn("skip", F.coalesce("skip", F.lit(0)))
    return x.select("host", "path", F.slice("rest", F.col("skip") + 1, F.size("rest")).alias("rest"), F.concat_ws("/", "branch", F.slice("rest", F.lit(1), F.col("skip"))).alias("branch"), "n", "labelled", "blocked")


def _grow(nodes: DataFrame, max_children: int, z: float) -> DataFrame:
    """One level of the tree: each node's branch with its next segment added."""
    nodes = nodes.withColumn("segment", F.get("rest", F.lit(0)))
    child = settle(nodes.groupBy(*_AT, "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))), "children")
    wide = _side(child.groupBy(*_AT).agg(F.count("*").alias("kids"), F.sum("n").alias("total")).filter(F.col("kids") > max_children).drop("kids"), "wide")
    rare = (F.col("n") * max_children < F.col("total")) & (F.col("segment") != "")  # not where total is null
    shape = F.when(rare, F.concat(F.lit("*"), F.regexp_extract("segment", r"(\.[A-Za-z]{1,5})$", 1))).otherwise(F.col("segment"))
    shaped = child.join(wide, _AT, "left").select(*_AT, "segment", shape.alias("shape"), "labelled", "blocked")
    kind = settle(shaped.groupBy(*_AT, "shape").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")), "kinds")
    pool = _side(kind.groupBy(*_AT).agg(F.count("*").alias("kinds"), ((F.sum("b") + 1.0) / (F.sum("m") + 2.0)).alias("p")).filter("kinds > 1").drop("kinds"), "pool")
    alike = F.pow(F.col("b") - F.col("m") * F.col("p"), 2) <= z * z * F.col("m") * F.col("p") * (1 - F.col("p"))
    merged = _side(kind.join(pool, _AT).filter(alike).select(*_AT, "shape", F.lit("~").alias("one")), "merged")
    moves = shaped.join(merged, [*_AT, "shape"], "left").select(*_AT, "segment", F.concat_ws("/", "branch", F.coalesce("one", "shape")).alias("next"))
    rest = F.slice("rest", F.lit(2), F.size("rest"))
    return nodes.join(moves, [*_AT, "segment"]).select("host", "path", rest.alias("rest"), F.col("next").alias("branch"), "n", "labelled", "blocked")


def _templates(nodes: DataFrame, max_children: int, z: float) -> DataFrame:
    """nodes -> host, path, branch, labelled, blocked, each path once: finished ones are written once and not carried on."""
    done = []
    while True:
        nodes = settle(_chains(nodes), "nodes")
        done.append(nodes.filter(F.size("rest") == 0).drop("rest"))
        open_ = nodes.filter(F.size("rest") > 0)
        if open_.isEmpty():
            break
        nodes = settle(_grow(open_, max_children, z), "nodes")
        done.append(nodes.filter(F.size("rest") == 0).drop("rest"))
        nodes = nodes.filter(F.size("rest") > 0)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", depth: int | None = None, max_children: int = 16, z: float = 2.0, weight: float = 4.0, limit: float = 0.5) -> DataFrame:
    """One row per page: id_col, host, path, rule, template, purity, verdict.  labels: key (an id), bad (boolean)."""
    if len(rules) > 1000:
        raise ValueError("at most 1,000 rules")
    seen = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    seen = seen.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumns({"rule": _rule(F.col("host"), F.col("path"), rules, 1), "ruled": _rule(F.col("host"), F.col("path"), rules, 0)})
    known = seen
    if labels is None:
        known = known.withColumn("bad", F.lit(None).cast("boolean"))
    else:
        one = labels.filter("bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
        known = known.join(one, known["id"] == one["key"], "left")
    bad = F.coalesce(F.col("ruled") == "block", "bad")
    nodes = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(bad).alias("labelled"), F.count(F.when(bad, 1)).alias("blocked"))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    if depth:
        segments = F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth - 1), F.array(F.lit("**")))).otherwise(segments)
    nodes = settle(nodes.select("host", "path", segments.alias("rest"), F.lit("").alias("branch"), "n", "labelled", "blocked"), "nodes")
    nodes = _templates(nodes, max_children, z)
    template = settle(nodes.groupBy("host", "branch").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")), "templates")
    by_host = _side(template.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("b").alias("hb")), "hosts")
    overall = template.agg(F.coalesce((F.sum("b") + 0.5) / (F.sum("m") + 2.0), F.lit(0.25)).alias("rate")).scalar()
    rate = (F.col("hb") + weight * overall) / (F.col("hm") + weight)
    judged = template.join(by_host, "host").select("host", "branch", ((F.col("b") + weight * rate) / (F.col("m") + weight)).alias("purity"))
    paths = nodes.join(judged, ["host", "branch"]).select("host", "path", F.col("branch").alias("template"), "purity")
    out = seen.join(paths, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= limit, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def duckdb_sql(rules: list[tuple[str, str]], labels: str, depth: int = 8, max_children: int = 16, z: float = 2.0, weight: float = 4.0, limit: float = 0.5) -> str:
    """The same for DuckDB over the table pages; labels is a query for (key, bad)."""
    whens = [[], []]
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule[1].partition("/")
        for k in (0, 1):
            whens[k].append(f"WHEN (host = '{name}' OR suffix(host, '.{name}')) AND prefix(path, '/{rest}') THEN '{rule[k]}'")
    sql = [
        f"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM rest),
seen AS (SELECT *, CASE {' '.join(whens[1])} END AS rule, CASE {' '.join(whens[0])} END AS ruled FROM parsed),
lab AS (SELECT key, bool_or(bad) AS bad FROM ({labels}) WHERE bad IS NOT NULL GROUP BY key),
known AS (SELECT host, path, coalesce(ruled = 'block', bad) AS bad FROM seen LEFT JOIN lab ON page_id = key),
n0 AS (SELECT host, path, string_split(regexp_replace(path, '^/', ''), '/') AS segments, '' AS branch, count(*) AS n, count(bad) AS labelled, count(*) FILTER (bad) AS blocked FROM known GROUP BY ALL)"""
    ]
    for k in range(1, depth + 1):
        segment = f"CASE WHEN len(segments) > {depth} THEN '**' ELSE segments[{k}] END" if k == depth else f"segments[{k}]"
        sql.append(f"""s{k} AS MATERIALIZED (SELECT *, {segment} AS segment FROM n{k - 1}),
c{k} AS (SELECT host, branch, segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER b > {max_children} AND n * {max_children} < sum(n) OVER b AND segment <> '' THEN '*' || regexp_extract(segment, '(\\.[A-Za-z]{{1,5}})$', 1) ELSE segment END AS shape FROM c{k} WINDOW b AS (PARTITION BY host, branch)),
k{k} AS (SELECT host, branch, shape, sum(labelled)::DOUBLE AS m, sum(blocked)::DOUBLE AS b FROM h{k} GROUP BY ALL),
p{k} AS (SELECT *, count(*) OVER w AS kinds, (sum(b) OVER w + 1.0) / (sum(m) OVER w + 2.0) AS p FROM k{k} WINDOW w AS (PARTITION BY host, branch)),
m{k} AS (SELECT h{k}.host, h{k}.branch, segment, h{k}.branch || '/' || CASE WHEN kinds > 1 AND pow(b - m * p, 2) <= {z * z} * m * p * (1 - p) THEN '~' ELSE shape END AS next FROM h{k} JOIN p{k} USING (host, branch, shape)),
n{k} AS MATERIALIZED (SELECT host, path, segments, coalesce(next, branch) AS branch, n, labelled, blocked FROM s{k} LEFT JOIN m{k} USING (host, branch, segment))""")
    sql.append(f"""t AS (SELECT host, branch, sum(labelled)::DOUBLE AS m, sum(blocked)::DOUBLE AS b FROM n{depth} GROUP BY ALL),
r AS (SELECT *, (sum(b) OVER h + {weight} * ((sum(b) OVER () + 0.5) / (sum(m) OVER () + 2.0))) / (sum(m) OVER h + {weight}) AS rate FROM t WINDOW h AS (PARTITION BY host)),
u AS (SELECT host, branch, (b + {weight} * rate) / (m + {weight}) AS purity FROM r)
SELECT page_id, host, path, rule, branch AS template, coalesce(ruled, CASE WHEN purity >= {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN n{depth} USING (host, path) LEFT JOIN u USING (host, branch)""")
    return ",\n".join(sql)
