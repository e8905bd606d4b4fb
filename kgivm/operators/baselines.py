"""Baselines that invalidate everything an edited sentence reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import provenance as pv
from kgivm.operators.policy import BASELINE_COST
from kgivm.operators.refresh import mark_stale
from kgivm.store import Graph

NAMES = {"traversal": "B1_traversal", "update": "B1_update", "naive": "B2_naive"}


@dataclass
class Invalidation:
    graph: Graph
    decisions: DataFrame  # src, target_type, target_id, decision, cost
    summary: DataFrame  # src, stale_entities, stale_relations, stale_count, cost


def invalidate(g: Graph, sents: DataFrame, step: int, kind: str = "naive", max_depth: int = 1, dry_run: bool = False) -> Invalidation:
    """Mark every object that the sentences (one column of ids) reach; each costs one rebuild. 'traversal' follows up to ``max_depth`` hops."""
    if kind not in NAMES:
        raise ValueError(f"kind: {kind}")
    found = pv.reachable(g, sents, max_depth if kind == "traversal" else 1)
    decisions = found.withColumn("decision", F.lit("REBUILD")).withColumn("cost", F.lit(BASELINE_COST)).withColumn("baseline", F.lit(NAMES[kind]))
    ids = lambda t: F.array_sort(F.collect_list(F.when(F.col("target_type") == t, F.col("target_id"))))
    summary = decisions.groupBy("src").agg(ids("entity").alias("stale_entities"), ids("relation").alias("stale_relations"), F.count("*").alias("stale_count"), F.sum("cost").alias("cost"))
    return Invalidation(g if dry_run else mark_stale(g, found, step), decisions, summary)


def run_edits(g: Graph, edits: DataFrame, step: int, kind: str = "naive", dry_run: bool = False) -> tuple[Graph, DataFrame]:
    """Overwrite the sentences and invalidate; returns the graph and, per edit, what this costs. There is no evidence delta."""
    named = edits.withColumn("sent_id", tx.sentence_id(F.col("doc_id"), F.col("sent_idx")))
    got = invalidate(g, named.select("sent_id"), step, kind, dry_run=dry_run)
    last = named.groupBy("sent_id").agg(F.max_by("new_text", "edit_seq").alias("_text"))
    rows = g["sentences"].join(last, "sent_id", "left")
    hit = F.col("_text").isNotNull()
    texts = rows.withColumns({"text": F.coalesce("_text", "text"), "text_hash": F.when(hit, tx.text_hash(F.col("_text"))).otherwise(F.col("text_hash")), "last_changed_step": F.when(hit, step).otherwise(F.col("last_changed_step"))})
    cost = named.join(got.summary.withColumnRenamed("src", "sent_id"), "sent_id", "left").withColumn("this_step", F.coalesce("cost", F.lit(0))).withColumn("vs_full_rebuild", F.col("this_step"))
    graph = got.graph if dry_run else got.graph.updated(step, sentences=texts.select(*g["sentences"].columns))
    return graph, cost.drop("cost")
