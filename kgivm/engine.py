"""One object with the operations of a maintained graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.functions import vectors as vx
from kgivm.operators import baselines, consistency, editor, evaluation, pipeline, retrieval, vector_index
from kgivm.operators import provenance as pv
from kgivm.sources import corpus
from kgivm.store import Graph, Store


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.store.init()

    @property
    def state(self) -> Graph:
        return self.store.load()

    def ingest(self, path: str, relation_path: str | None = None, limit: int | None = None, clear: bool = True) -> int:
        """Load a corpus file (replacing the graph, or added to it); returns the number of documents."""
        parsed = corpus.parse_corpus(self.spark, path, relation_path, limit)
        tables = corpus.ingest(parsed)
        if not clear:
            old = self.state
            tables = {t: old[t].unionByName(df) for t, df in tables.items()}
        return self.store.commit(Graph(tables, batch=self.state.batch))["documents"].count()

    def graph(self, fresh_only: bool = False) -> tuple[DataFrame, DataFrame]:
        return pv.graph_view(self.state, fresh_only)

    def sentences(self, doc_id: str | None = None) -> DataFrame:
        return pv.sentences(self.state, doc_id)

    def apply(self, edits: DataFrame, mode: str = "immediate") -> pipeline.BatchResult:
        return pipeline.run_batch(self.store, edits, mode)

    def instruct(self, instructions: DataFrame, mode: str = "immediate", dry_run: bool = False, **options):
        """Edits for instructions; applied unless ``dry_run``."""
        edits = editor.build_edits(self.state, instructions, **options)
        return edits if dry_run else self.apply(edits.drop("instruction_id"), mode)

    def refresh(self, step: int | None = None, only: str | None = None):
        return pipeline.tick(self.store, step, only)

    def reset(self) -> Graph:
        return self.store.clear()

    def deltas(self, step: int | None = None) -> DataFrame:
        return pv.logged(self.state, "evidence_deltas", step)

    def decisions(self, step: int | None = None) -> DataFrame:
        return pv.logged(self.state, "refresh_decisions", step)

    def metrics(self, step: int | None = None) -> DataFrame:
        return evaluation.metrics_summary(self.state, step)

    def check(self, doc_id: str | None = None, require_fresh: bool = False) -> tuple[DataFrame, DataFrame]:
        return consistency.check(self.state, doc_id, require_fresh)

    def baseline(self, sents: DataFrame, kind: str = "naive", dry_run: bool = True) -> DataFrame:
        g = self.state
        got = baselines.invalidate(g, sents, g.step, kind, dry_run=dry_run)
        if not dry_run:
            self.store.commit(got.graph)
        return got.summary

    def embed(self, doc_id: str | None = None) -> DataFrame:
        return retrieval.embedded(self.store.commit(retrieval.store_embeddings(self.state, doc_id)))

    def search(self, queries: DataFrame, **options) -> DataFrame:
        return retrieval.semantic_search(self.state, queries, **options)

    def index(self, lists: int | None = None) -> str:
        """Build the index over the stored vectors; its status. An edit does not change an index, so build it again after edits."""
        return vector_index.build(self.state["sentences"].select("sent_id", "doc_id", "idx", "text", "embedding"), f"{self.store.path}/index", lists=lists).status

    def indexed_search(self, queries: DataFrame, *, limit: int = 5, threshold: float | None = None, probes: int | None = None) -> DataFrame:
        """As ``search``, over the lists nearest to each query."""
        vectors = queries.where(tx.strip(F.col("query")) != "").select("query_id", vx.hashed_embedding(F.col("query")).alias("query_vector"))
        return vector_index.search(vector_index.load(self.spark, f"{self.store.path}/index"), vectors, key="sent_id", limit=limit, threshold=threshold, probes=probes)

    def counts(self) -> DataFrame:
        return pv.counts(self.state)

    def explain(self, sents: DataFrame) -> None:
        """The plans of the one-hop and the closure reads."""
        pv.affected(self.state, sents).explain("formatted")
        pv.reachable(self.state, sents).explain("formatted")
