"""Vector search over sentences: exact, query blocks against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.functions import vectors as vx
from kgivm.store import Graph

BACKENDS = ("lightweight",)
SIMILARITY_THRESHOLD = 0.85


def backend(name: str = "auto") -> str:
    """The embedding backend for a setting; model-based ones need a model that is not part of this library."""
    if name in ("auto", "lightweight"):
        return "lightweight"
    raise ValueError(f"embedding backend: {name}")


def store_embeddings(g: Graph, doc_id: str | None = None) -> Graph:
    """Embed all sentences with text (of one document)."""
    want = F.col("text") != ""
    if doc_id is not None:
        want = want & (F.col("doc_id") == doc_id)
    rows = g["sentences"]
    return g.updated(sentences=rows.withColumns({
        "embedding": F.when(want, vx.hashed_embedding(F.col("text"))).otherwise(F.col("embedding")), "embedding_backend": F.when(want, BACKENDS[0]).otherwise(F.col("embedding_backend")),
    }))


def embedded(g: Graph) -> DataFrame:
    """One row: sentences with a vector, its dimension, the list count an inverted file would get, and whether one can be built (see ``vector_index``)."""
    n = F.count("embedding")
    lists = F.when(n > 0, F.greatest(F.lit(1), F.least(n, F.round(15 * F.sqrt(n)).cast("long"))))
    return g["sentences"].agg(n.alias("embedded"), F.max(F.size("embedding")).alias("dimension"), lists.alias("lists"), F.when(n > 0, "embedded").otherwise("missing_embeddings").alias("status"))


def search(rows: DataFrame, queries: DataFrame, *, key: str, limit: int = 5, threshold: float | None = None) -> DataFrame:
    """The ``limit`` best rows of every query by cosine: query_id, ``key``, score, rank.

    ``rows``: key, embedding. ``queries`` (query_id, query_vector) are the query
    set, sent to all tasks. Each task keeps its own best rows before the shuffle
    (a window group limit), so ``limit`` rows per query and task are moved.
    """
    scored = rows.where("embedding is not null").crossJoin(F.broadcast(queries)).withColumn("score", vx.cosine(F.col("embedding"), F.col("query_vector"))).drop("embedding", "query_vector")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def search_texts(rows: DataFrame, queries: DataFrame, *, key: str, threshold: float) -> DataFrame:
    """All rows of a cosine of ``threshold`` or more with a query, by hashed embeddings: query_id, ``key``, score.

    ``rows``: key, text. ``queries`` (query_id, text) are the query set, held by
    the driver and sent to all tasks. Whole batches are embedded and compared,
    as the column expression takes 0.1 s a text. Zero vectors are like nothing.
    """
    spark = rows.sparkSession
    asked = queries.select("query_id", "text").toArrow()
    vectors = vx.hashed_counts(asked["text"].to_pylist())
    sent = spark.sparkContext.broadcast((asked["query_id"].combine_chunks(), vectors, np.sqrt((vectors * vectors).sum(1))))

    def compare(batches):
        ids, q, q_norm = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                d = vx.hashed_counts(part.column(1).to_pylist())
                norms = np.outer(np.sqrt((d * d).sum(1)), q_norm)
                score = np.divide(d @ q.T, norms, out=np.zeros_like(norms), where=norms > 0)
                i, j = np.nonzero((score >= threshold) & (norms > 0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(score[i, j])], ["query_id", key, "score"])

    src = rows.select(key, "text")
    kinds = queries.schema["query_id"].dataType.simpleString(), src.schema[key].dataType.simpleString()
    return src.mapInArrow(compare, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")


def semantic_search(g: Graph, queries: DataFrame, *, doc_id: str | None = None, limit: int = 5, threshold: float | None = None) -> DataFrame:
    """``queries``: query_id, query (text; blank ones find nothing)."""
    rows = g["sentences"].select("sent_id", "doc_id", "idx", "text", "embedding")
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    vectors = queries.where(tx.strip(F.col("query")) != "").select("query_id", vx.hashed_embedding(F.col("query")).alias("query_vector"))
    return search(rows, vectors, key="sent_id", limit=limit, threshold=threshold)


def similar_after_edit(g: Graph, edits: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """sent_id, similarity (null without a stored vector), is_similar, the first ten dimensions of both vectors."""
    new = edits.withColumn("sent_id", tx.sentence_id(F.col("doc_id"), F.col("sent_idx"))).select("sent_id", vx.hashed_embedding(F.col("new_text")).alias("v"))
    rows = new.join(g["sentences"].select("sent_id", "embedding"), "sent_id", "left")
    similarity = F.when(F.col("embedding").isNotNull(), vx.cosine(F.col("embedding"), F.col("v")))
    return rows.select("sent_id", similarity.alias("similarity"), F.coalesce(similarity >= threshold, F.lit(False)).alias("is_similar"), F.slice("embedding", 1, 10).alias("old_head"), F.slice("v", 1, 10).alias("new_head"))
