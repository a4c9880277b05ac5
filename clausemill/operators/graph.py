"""The property graph: nodes, edges with evidence, their union over documents, and counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.values import properties

PROVENANCE = ["document_id", "clause_id", "clause_no", "page", "match_type", "match_confidence", "review_required", "catalog_version"]
_TYPES = ["string", "string", "string", "int", "string", "double", "boolean", "string"]


_EDGE = f"struct<{','.join(f'{n}:{t}' for n, t in zip(PROVENANCE, _TYPES, strict=True))}>"
_CLAUSE_STEP, _CATALOG_STEP = 1 << 60, 1 << 61


def _evidence(**known: Column) -> Column:
    return F.struct(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(PROVENANCE, _TYPES, strict=True)))


def _node(kind: str, key: Column, arrival: Column, when: Column | None = None, **props: Column) -> Column:
    """A node as a struct, or null unless `when`."""
    node = F.struct(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), properties(**props).alias("entries"), arrival.cast("long").alias("arrival"))
    return node if when is None else F.when(when, node)


def _there(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A catalog or a vocabulary, broadcast up to `most` rows: what names its entries has a few of them over and over, and would not be spread by them."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _edges(df: DataFrame, source: Column, target: Column, kind: str, evidence: Column | None, there: str | None = None) -> DataFrame:
    """Edges of one kind, of the rows where `there` is."""
    rows = df if there is None else df.filter(_there(there))
    return rows.select("stem", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), (F.lit(None).cast(_EDGE) if evidence is None else evidence).alias("provenance"))


def _each(df: DataFrame, *made: Column) -> DataFrame:
    """stem and the fields of every struct made from a row: one pass over df, whatever the number of structs."""
    return df.select("stem", F.explode(F.array_compact(F.array(*made))).alias("x")).select("stem", "x.*")


def merge_nodes(nodes: DataFrame, group: list[str] | None = None, counted: bool = False) -> DataFrame:
    """nodes (id, type, entries, arrival) -> one row per id: of each property the first value in order of arrival; the type of the first.

    Equal rows are counted once before the shuffle, so a node that a third of all rows name stays small; counted says that they are already.
    """
    keys = [*(group or []), "id"]
    once = nodes if counted else nodes.groupBy(*keys, "type", "entries").agg(F.min("arrival").alias("arrival"))
    forms = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("arrival", "type", "entries"))).alias("f"))
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate("f", empty, lambda have, x: F.map_concat(have, F.map_filter(F.map_from_entries(x["entries"]), lambda k, _: ~F.map_contains_key(have, k))))
    first = F.col("f")[0]
    return forms.select(*keys, first["type"].alias("type"), F.when(F.size("f") == 1, F.map_from_entries(first["entries"])).otherwise(merged).alias("properties"))


def _seen(rows: DataFrame, *kinds: tuple[str, str, Column], by: tuple[str, ...] = ("stem",)) -> DataFrame:
    """stem, type, key, label, ord: the different (type, key, label) that a document's rows name, or all rows without `by`, each at its first row.

    kinds: (type, key column, label).  Keys and labels are grouped before any property is built.
    """
    none = F.lit(None).cast("string")
    named = F.array_compact(F.array(*(F.when(_there(key), F.struct(F.lit(kind).alias("type"), F.col(key).alias("key"), (none if label is None else label).alias("label"))) for kind, key, label in kinds)))
    found = rows.select("stem", "ord", F.explode(named).alias("x")).select("stem", "ord", "x.*")
    return found.groupBy(*by, "type", "key", "label").agg(F.min(F.struct("stem", "ord")).alias("at")).select("at.stem", "type", "key", "label", "at.ord")


def structural_once(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Edges without evidence once for each (source, target, type); those with evidence all."""
    keys = [*(group or []), "source", "target", "type"]
    bare = edges.filter("provenance IS NULL").dropDuplicates(keys)
    return bare.unionByName(edges.filter("provenance IS NOT NULL"))


@dataclass(frozen=True)
class Graph:
    """What the graphs of all documents are made of.  rows: clauses with their document, mapping and domain, `named` where a clause is the first
    of its document that maps to its concept, `common` where another document may have a node of the same id.  meta: the documents.

    Nodes and edges are projections of these tables, a branch for each kind; what asks for one kind reads that branch alone.
    """

    rows: DataFrame
    meta: DataFrame
    catalog: DataFrame

    def _with_catalog(self, df: DataFrame) -> DataFrame:
        """Rows with a canonical_id, with its entry in the catalog and its parent's."""
        col = F.col
        entry = self.catalog.select(col("canonical_id").alias("__id"), col("label").alias("cat_label"), col("domain").alias("cat_domain"), col("status").alias("cat_status"), col("parent").alias("cat_parent"))
        parent = self.catalog.select(col("canonical_id").alias("__pid"), col("label").alias("parent_label"), col("domain").alias("parent_domain"), col("status").alias("parent_status"))
        return df.join(_few(entry), col("canonical_id") == col("__id")).join(_few(parent), col("cat_parent") == col("__pid"), "left")

    def _shared(self, seen: DataFrame, here: DataFrame, issued: DataFrame) -> DataFrame:
        """stem, id, type, entries, arrival of the nodes that several clauses or documents name."""
        col, later = F.col, F.col("ord") + _CATALOG_STEP
        entry = self.catalog.select(col("canonical_id").alias("__id"), col("label").alias("cat_label"), col("domain").alias("cat_domain"), col("status").alias("cat_status"))
        seen = seen.join(_few(entry), (col("type") == "Concept") & (col("key") == col("__id")), "left")
        of_concept = properties(canonical_id=col("key"), label=tx.present("label", "cat_label"), domain=col("cat_domain"), status=col("cat_status"))
        shared = seen.select("stem", F.concat("type", F.lit(":"), "key").alias("id"), "type", F.when(col("type") == "Concept", of_concept).otherwise(properties(label=col("key"))).alias("entries"), (col("ord") + _CLAUSE_STEP).alias("arrival"))
        return shared.unionByName(
            _each(
                self._with_catalog(here),
                _node("Concept", col("cat_parent"), later, _there("cat_parent"), canonical_id=col("cat_parent"), label=col("parent_label"), domain=col("parent_domain"), status=col("parent_status")),
                _node("Domain", col("cat_domain"), later, _there("cat_domain"), label=col("cat_domain")),
            )
        ).unionByName(_each(issued, _node("Regulator", col("regulator"), F.lit(0), _there("regulator"), name=col("regulator"), country=col("regulator_country"))))

    def _named(self, *by: str) -> DataFrame:
        rows = self.rows.withColumns({"__duty": F.col("semantic.obligation_type"), "__label": tx.present("o.canonical_label")})
        return _seen(rows, ("Domain", "domain_label", None), ("ObligationType", "__duty", None), ("Concept", "canonical_id", F.col("__label")), by=by)

    def _single(self) -> tuple[DataFrame, DataFrame]:
        """stem, id, type, properties, common: documents, and clauses."""
        col = F.col
        made = lambda df, node: df.select("stem", node["id"].alias("id"), node["type"].alias("type"), F.map_from_entries(node["entries"]).alias("properties"), "common")
        return (
            made(self.meta, _node("Document", col("document_id"), F.lit(0), title=col("title"), source_type=col("source_type"), version=col("version"), jurisdiction=col("jurisdiction"), stem=col("stem"), regulator=col("regulator"))),
            made(self.rows, _node("Clause", F.concat("document_id", F.lit("/"), "clause_id"), F.lit(0), clause_no=col("clause_no"), title=col("title"), text=col("text"), page=col("page_reference"), mandatory_flag=tx.present("semantic.mandatory_flag"), action=tx.present("semantic.action"))),
        )

    def nodes(self) -> DataFrame:
        """stem, id, type, properties of every document's own graph."""
        here = self.rows.filter("named").select("stem", "canonical_id", "ord")
        shared = merge_nodes(self._shared(self._named("stem"), here, self.meta), ["stem"], counted=True)
        return reduce(DataFrame.unionByName, (x.drop("common") for x in self._single())).unionByName(shared)

    def shared_nodes(self) -> DataFrame:
        """The nodes that documents share, as union_graphs() leaves them: few, found without a document's nodes being built.

        Of each form the first place is enough, as the forms of a node's first document are those whose first place is in it.
        """
        first = F.min(F.struct("stem", "ord")).alias("at")
        here = self.rows.filter("named").groupBy("canonical_id").agg(first).select("at.stem", "at.ord", "canonical_id")
        issued = self.meta.filter(_there("regulator")).groupBy("regulator", "regulator_country").agg(F.min("stem").alias("stem"))
        forms = self._shared(self._named(), here, issued).groupBy("id", "type", "entries").agg(F.min(F.struct("stem", "arrival")).alias("at")).select("at.stem", "id", "type", "entries", "at.arrival")
        of_first = forms.withColumn("__first", F.min("stem").over(Window.partitionBy("id"))).filter("stem = __first").drop("__first")
        return merge_nodes(of_first, ["stem"], counted=True)

    def united(self, shared: DataFrame) -> DataFrame:
        """union_graphs() of nodes().  shared: shared_nodes(), or a table of them.  Documents and clauses are grouped only where another may have their id."""
        alone = reduce(DataFrame.unionByName, (x.filter("NOT common").drop("common") for x in self._single()))
        twice = reduce(DataFrame.unionByName, (x.filter("common").drop("common") for x in self._single()))
        return alone.unionByName(union_graphs(twice, twice)[0]).unionByName(shared)

    def edges(self) -> DataFrame:
        """stem, source, target, type, provenance of every document's own graph."""
        col = F.col
        doc, clause = F.concat(F.lit("Document:"), col("document_id")), F.concat(F.lit("Clause:"), col("document_id"), F.lit("/"), col("clause_id"))
        mark = {"document_id": col("document_id"), "clause_id": col("clause_id"), "clause_no": col("clause_no"), "page": col("page_reference")}
        mapping = {k: col(f"o.{k}") for k in ("match_type", "match_confidence", "review_required")}
        to = lambda kind, name: F.concat(F.lit(f"{kind}:"), col(name))
        here, version = self._with_catalog(self.rows.filter("named").select("stem", "canonical_id", "catalog_version")), _evidence(catalog_version=col("catalog_version"))
        kinds = [
            structural_once(_edges(self.meta, doc, to("Regulator", "regulator"), "ISSUED_BY", None, "regulator"), ["stem"]),
            _edges(self.rows, doc, clause, "HAS_CLAUSE", None),
            _edges(self.rows, clause, to("Domain", "domain_label"), "IN_DOMAIN", _evidence(**mark), "domain_label"),
            _edges(self.rows, clause, to("ObligationType", "semantic.obligation_type"), "HAS_OBLIGATION", _evidence(**mark), "semantic.obligation_type"),
            _edges(self.rows, clause, to("Concept", "canonical_id"), "MAPS_TO_CONCEPT", _evidence(**mark, **mapping), "canonical_id"),
            _edges(here, to("Concept", "canonical_id"), to("Concept", "cat_parent"), "CHILD_OF", version, "cat_parent"),
            _edges(here, to("Concept", "canonical_id"), to("Domain", "cat_domain"), "IN_DOMAIN", version, "cat_domain"),
        ]
        return reduce(DataFrame.unionByName, kinds)


def graph(clauses: DataFrame, objects: DataFrame | None, metadata: DataFrame, catalog: DataFrame, domains: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Graph:
    """metadata: stem, document_id, regulator, regulator_country, title, source_type, version, jurisdiction, catalog_version.

    objects: the clauses' mappings, or None where clauses have theirs as a struct `o`.  A clause's id is unique in its document (number_clauses).
    Clauses meet their document by stem, so rows that are dealt out by stem are not shuffled again.  keep(name, df) may write the documents and the rows.
    """
    col = F.col
    meta = metadata.withColumn("document_id", tx.present("document_id", "stem"))
    meta = keep("graph_documents", meta.withColumn("common", F.count("*").over(Window.partitionBy("document_id")) > 1))
    labels = domains.select(col("token").alias("__t"), col("label").alias("domain_label"))
    if objects is not None:
        own = objects.groupBy("stem", "clause_id").agg(F.max_by(F.struct("canonical_id", "canonical_label", "match_type", "match_confidence", "review_required"), "ord").alias("o"))
        clauses = clauses.join(own, ["stem", "clause_id"], "left")
    joined = clauses.withColumn("canonical_id", col("o.canonical_id")).join(meta.select("stem", "document_id", "catalog_version", "common"), "stem")
    turn = F.row_number().over(Window.partitionBy("stem", "canonical_id").orderBy("ord"))
    marked = joined.withColumns({"named": _there("canonical_id") & (turn == 1), "common": col("common") | F.contains(F.concat("document_id", "clause_id"), F.lit("/"))})  # "a" + "b/c" is "a/b" + "c"
    return Graph(keep("graph_rows", marked.join(_few(labels), col("semantic.domain") == col("__t"), "left").drop("__t")), meta, catalog)


def build_graph(clauses: DataFrame, objects: DataFrame | None, metadata: DataFrame, catalog: DataFrame, domains: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every document; the arguments of graph()."""
    made = graph(clauses, objects, metadata, catalog, domains, keep)
    return made.nodes(), made.edges()


def union_graphs(nodes: DataFrame, edges: DataFrame, order: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Graphs of all documents as one: of equal node ids the first document's row, all edges."""
    first = nodes.groupBy("id").agg(F.min_by(F.struct("type", "properties"), order).alias("n"), F.min(order).alias(order))
    return first.select(order, "id", "n.type", "n.properties"), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what ('node' or 'edge'), type, n."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n").unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def type_counts(nodes: DataFrame, kind: str = "type") -> DataFrame:
    """Rows by type, and in all (type null)."""
    return nodes.rollup(kind).agg(F.count("*").alias("n"))
