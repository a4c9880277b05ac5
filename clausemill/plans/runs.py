"""Runs that follow a corpus: a step sees the documents that changed, and the tables change for all readers at once.

A run's rows lie in a folder of their own in each step's table (`<step>/run=<n>`), and its log says which documents it read, with a hash of
their content, or that they are gone.  A document's rows are those of its latest committed run; older ones stay in their folders
unseen until compact().  A run counts once its record is renamed to `commits/<n>`, which one of several writers can do; what a
failed run left behind has no record, is seen by nobody, and is written over by the next.

Document frequencies are kept by signed differences: a run writes, for each term, in how many clauses of changed documents it is now less
in how many it was.  Their sum is what a count over all live postings gives, so the index's idf follows the corpus without reading it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import adjacency as ad
from clausemill.operators import clauses as cl
from clausemill.operators import extract, graph, index, interpret, matching, search, structure
from clausemill.tables import settle

#: Tables of live rows by document.  The last three are in folders by key.
STEPS = ["lines", "tree", "nodes", "clauses", "objects", "graph_nodes", "graph_edges", "postings", "nodes_by_id", "edges_by_source", "edges_by_target"]
_LOG = "stem string, hash string, alive boolean, run int"
_DELTA = "term string, d_df long, d_rows long, run int"


def content_hash(pages: DataFrame) -> DataFrame:
    """stem, hash: of the pages as a set, added up page by page; no document is gathered.  A column file_hash is used where there is one."""
    if "file_hash" in pages.columns:
        return pages.groupBy("stem").agg(F.min("file_hash").alias("hash"))
    both = [F.xxhash64("page_no", "text"), F.xxhash64(F.lit(7), "page_no", "text")]
    return pages.groupBy("stem").agg(F.concat_ws(":", F.count("*").cast("string"), *(F.hex(F.bit_xor(x)) for x in both), F.hex(F.sum(both[0].bitwiseAND(F.lit((1 << 40) - 1))))).alias("hash"))


def _of_rows(df: DataFrame) -> str:
    """A hash of a small table's rows in any order."""
    r = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).agg(F.count("*"), F.bit_xor(F.xxhash64("j")), F.bit_xor(F.xxhash64(F.lit(7), "j"))).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


@dataclass(frozen=True)
class Change:
    """What a run did: its number (None if there was nothing to do), and how many documents were read and were gone."""

    run: int | None
    read: int
    gone: int


class Runs:
    """Tables of a corpus below `path`, as of the last commit when this object was made or last updated."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.refresh()

    def _at(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def refresh(self) -> None:
        """See what has been committed since."""
        where = self._at("commits")
        names = [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []
        self.head = max((int(x) for x in names if x.isdigit()), default=0)
        self.base = 0
        if self.head:
            stream = self._fs.open(self._at(f"commits/{self.head:08d}"))
            try:
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self.base = said["base"]

    def _commit(self, run: int, base: int) -> None:
        aside, place = self._at(f"commits/_{uuid.uuid4().hex}"), self._at(f"commits/{run:08d}")
        out = self._fs.create(aside, False)
        out.write(json.dumps({"base": base}).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, place, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(place):
                raise RuntimeError(f"another run was committed as {run}; update again") from error
            raise
        self.refresh()

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """Rows of committed runs since the last compaction; folders of other runs are not opened."""
        folder = self._at(name)
        runs = [int(x.getPath().getName()[4:]) for x in self._fs.listStatus(folder) if x.getPath().getName().startswith("run=")] if self._fs.exists(folder) else []
        runs = sorted(k for k in runs if max(self.base, 1) <= k <= self.head)
        if not runs:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/run={k}" for k in runs))

    def documents(self) -> DataFrame:
        """stem, hash, run of the documents that live."""
        last = self._read("documents", _LOG).groupBy("stem").agg(F.max_by(F.struct("hash", "alive", "run"), "run").alias("x"))
        return last.filter("x.alive").select("stem", "x.hash", "x.run")

    def table(self, name: str) -> DataFrame:
        """A step's rows of live documents."""
        rows = self._read(name)
        if rows is None:
            raise ValueError(f"no run has been committed at {self.path}")
        return rows.join(self.documents().select("stem", "run"), ["stem", "run"], "left_semi").drop("run")

    def __getattr__(self, name: str) -> DataFrame:
        """Tables by name, as those of a whole run."""
        if name in STEPS:
            return self.table(name)
        raise AttributeError(name)

    def adjacency(self) -> ad.Adjacency:
        return ad.Adjacency(self.table("nodes_by_id"), self.table("edges_by_source"), self.table("edges_by_target"))

    def idf(self) -> DataFrame:
        """term, df, idf over all live documents, from the sums of differences."""
        return index.idf_of_changes(self._read("df_changes", _DELTA))

    def _df_changes(self, post: DataFrame, rows: DataFrame, left: DataFrame) -> DataFrame:
        """What the new postings add and those of the documents `left` took away."""
        changes = index.frequency_changes(post, rows)
        if self.head:
            old = [self.table(name).join(left, "stem", "left_semi") for name in ("postings", "clauses")]
            changes = changes.unionByName(index.frequency_changes(*old, sign=-1))
        return index.add_changes(changes)

    def update(self, pages: DataFrame, catalog: DataFrame, domains: DataFrame, metadata: DataFrame, whole: bool = True, denoise: bool = True, classifier: Callable | None = None, level_hook: Callable | None = None, rules: matching.Rules = matching.Rules(), version: str = "") -> Change:
        """Bring the tables up to date with pages (stem, page_no, text) and metadata, reading only the documents whose content differs.

        whole: documents that are not in pages are gone; otherwise they stay as they are.  Another catalog, other domains, rules or version
        (a name for the hooks' behaviour) count as other content of every document.
        """
        spark, run = self.spark, self.head + 1
        settings = "|".join([_of_rows(catalog), _of_rows(domains), repr(rules), str(denoise), version])
        about = metadata.groupBy("stem").agg(F.hex(F.bit_xor(F.xxhash64(F.to_json(F.struct(*sorted(metadata.columns)))))).alias("about"))
        now = content_hash(pages).join(about, "stem", "left").select("stem", F.sha2(F.concat_ws("/", "hash", "about", F.lit(settings)), 256).alias("hash"))
        before = self.documents().select("stem", F.col("hash").alias("was"))
        both = settle(now.join(before, "stem", "full"), "compared")
        changed = both.filter("hash IS NOT NULL AND (was IS NULL OR was <> hash)").select("stem", "hash")
        gone = both.filter("hash IS NULL").select("stem") if whole else both.filter("false").select("stem")
        n_read, n_gone = changed.count(), gone.count()
        if not n_read and not n_gone:
            return Change(None, 0, 0)
        stems = changed.select("stem")

        def keep(name: str, df: DataFrame) -> DataFrame:
            path, writer = f"{self.path}/{name}/run={run}", df.write.mode("overwrite")
            (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        labels = [r["label"] for r in domains.select("label").collect()]  # a taxonomy of tens of rows
        own = pages.join(stems, "stem", "left_semi").select("stem", "page_no", "text")
        lines = keep("lines", extract.markdown_lines(extract.denoise_pages(own) if denoise else own))
        tree = keep("tree", structure.build_structure(lines, level_hook))
        nodes = keep("nodes", interpret.tag_units(tree, labels, classifier))
        clauses = keep("clauses", cl.export_clauses(nodes, domains))
        objects = keep("objects", matching.ontology_objects(clauses, catalog, domains, rules))
        made = graph.build_graph(clauses, objects, metadata.join(stems, "stem", "left_semi"), catalog, domains, lambda name, df: settle(df, name))
        graph_nodes, graph_edges = keep("graph_nodes", made[0]), keep("graph_edges", made[1])
        ad.store(graph_nodes, graph_edges, keep)
        post = keep("postings", index.postings(clauses))
        keep("df_changes", self._df_changes(post, clauses, stems.unionByName(gone)))
        keep("documents", changed.select("stem", "hash", F.lit(True).alias("alive")).unionByName(gone.select("stem", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("alive"))))
        self._commit(run, max(self.base, 1))
        return Change(run, n_read, n_gone)

    def build_index(self) -> search.Index:
        """A stored index of the present state, for this state only; idf comes from the differences."""
        post = self.table("postings")

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{self.path}/index/{self.head}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/index/{self.head}/{name}")

        idf = settle(self.idf(), "idf")
        weights = keep("weights", search.impact_ordered(index.unit_weights(post, idf)))
        return search.Index(keep("lexicon", search.lexicon(weights, idf)), weights)

    def stored_index(self) -> search.Index | None:
        """The index of the present state, if it has been built."""
        if not self._fs.exists(self._at(f"index/{self.head}/lexicon/_SUCCESS")):
            return None
        return search.Index(*(self.spark.read.parquet(f"{self.path}/index/{self.head}/{name}") for name in ("lexicon", "weights")))

    def top_scores(self, query: str, k: int) -> DataFrame:
        """stem, ord, score of the clauses that may be among the best k: from the stored index, or from live postings where it is behind."""
        stored = self.stored_index()
        return index.sparse_scores(self.table("postings"), self.idf(), query) if stored is None else search.top_scores(stored, query, k)

    def compact(self) -> None:
        """All live rows as one run, from which readers then start; folders before it are deleted by vacuum()."""
        run = self.head + 1

        def keep(name: str, df: DataFrame) -> None:
            (df.repartition("bucket").write.partitionBy("bucket") if "bucket" in df.columns else df.write).mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

        for name in STEPS:
            keep(name, self.table(name))
        keep("df_changes", index.add_changes(self._read("df_changes", _DELTA)))
        keep("documents", self.documents().select("stem", "hash", F.lit(True).alias("alive")))
        self._commit(run, run)

    def vacuum(self) -> None:
        """Delete folders of runs before the last compaction: when no reader uses them any more."""
        for name in [*STEPS, "df_changes", "documents"]:
            folder = self._at(name)
            for x in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if x.getPath().getName().startswith("run=") and int(x.getPath().getName()[4:]) < self.base:
                    self._fs.delete(x.getPath(), True)
