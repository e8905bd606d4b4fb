"""Decisions: what a change of evidence costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATCH_COST, REBUILD_COST, BASELINE_COST = 1, 5, 1
# The texts logged with each decision.
REASONS = {
    "SKIP": "Evidence is semantically unchanged",
    "PATCH added": "New active evidence can be patched into aggregates",
    "REBUILD": "Last active evidence was removed",
    "PATCH removed": "Evidence was removed but other active evidence remains",
}


def target_type(scope: str = "scope"):
    return F.when(F.col(scope) == "mention", "entity").otherwise("relation")


def active_counts(edges: DataFrame) -> DataFrame:
    """dst, active: edges whose status is active (unlike traversals, which follow all but removed ones)."""
    return edges.groupBy("dst").agg(F.count_if(F.col("status") == "active").alias("active"))


def ledger(deltas: DataFrame, start: DataFrame) -> DataFrame:
    """``deltas`` with ``remaining``: the target's active evidence after the edit. Changes of one edit count together, those of later edits not yet. ``start``: scope, target_id, active."""
    upto = Window.partitionBy("scope", "target_id").orderBy("edit_seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.join(start, ["scope", "target_id"], "left").withColumn("remaining", F.coalesce("active", F.lit(0)) + F.sum("changed").over(upto)).drop("active")


def decide(deltas: DataFrame) -> DataFrame:
    """Adds target_type, decision, decision_reason and cost to deltas with ``remaining``."""
    kind, last = F.col("delta_type"), F.col("remaining") <= 0
    decision = F.when(kind == "unchanged", "SKIP").when((kind == "removed") & last, "REBUILD").otherwise("PATCH")
    reason = F.when(kind == "unchanged", REASONS["SKIP"]).when(kind == "added", REASONS["PATCH added"]).when(last, REASONS["REBUILD"]).otherwise(REASONS["PATCH removed"])
    cost = F.when(F.col("decision") == "SKIP", 0).when(F.col("decision") == "REBUILD", REBUILD_COST).otherwise(PATCH_COST)
    return deltas.withColumn("target_type", target_type()).withColumn("decision", decision).withColumn("decision_reason", reason).withColumn("cost", cost)
