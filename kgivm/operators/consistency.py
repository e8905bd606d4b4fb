"""Recomputation from scratch, and what rebuilding would cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import provenance as pv
from kgivm.operators.policy import REBUILD_COST, active_counts
from kgivm.store import Graph


def recomputed(g: Graph) -> DataFrame:
    """target_type, target_id, rebuilt: active edges of every object, 0 included."""
    out = []
    for table, edges, key, kind in (("entities", "mentions", "entity_id", "entity"), ("relations", "sentence_supports_relation", "relation_id", "relation")):
        n = active_counts(g[edges]).withColumnRenamed("dst", key)
        out.append(g[table].select(key).join(n, key, "left").select(F.lit(kind).alias("target_type"), F.col(key).alias("target_id"), F.coalesce("active", F.lit(0)).alias("rebuilt")))
    return out[0].unionByName(out[1])


def maintained(g: Graph) -> DataFrame:
    """target_type, target_id, doc_id, stored, freshness_status, status (null for entities)."""
    e = g["entities"].select(F.lit("entity").alias("target_type"), F.col("entity_id").alias("target_id"), "doc_id", F.col("evidence_count").alias("stored"), "freshness_status", F.lit(None).cast("string").alias("status"))
    return e.unionByName(g["relations"].select(F.lit("relation").alias("target_type"), F.col("relation_id").alias("target_id"), "doc_id", F.col("evidence_count").alias("stored"), "freshness_status", "status"))


def check(g: Graph, doc_id: str | None = None, require_fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mismatches (kind, target_id, stored, rebuilt), and a one-row summary."""
    counts = [active_counts(g[t]).select(F.lit(kind).alias("target_type"), F.col("dst").alias("target_id"), "active") for t, kind in (("mentions", "entity"), ("sentence_supports_relation", "relation"))]
    rows = maintained(g).join(counts[0].unionByName(counts[1]), ["target_type", "target_id"], "left").withColumn("rebuilt", F.coalesce("active", F.lit(0)))
    if doc_id is not None:
        rows = rows.where(tx.in_doc(F.col("target_id"), doc_id))
    removed = F.col("status").eqNullSafe("removed")
    relation = F.col("target_type") == "relation"
    stale = F.lit(require_fresh) & ~(relation & removed) & ~F.col("freshness_status").eqNullSafe("fresh")
    stored, rebuilt = F.col("stored").cast("string"), F.col("rebuilt").cast("string")
    found = F.array(
        F.when(~F.col("stored").eqNullSafe(F.col("rebuilt")), F.struct(F.concat("target_type", F.lit("_count")).alias("kind"), stored.alias("stored"), rebuilt.alias("rebuilt"))),
        F.when(relation & removed & (F.col("rebuilt") > 0), F.struct(F.lit("relation_status").alias("kind"), F.lit("removed").alias("stored"), F.concat(rebuilt, F.lit(" active edges")).alias("rebuilt"))),
        F.when(stale, F.struct(F.lit("stale").alias("kind"), F.col("freshness_status").alias("stored"), F.lit("fresh").alias("rebuilt"))),
    )
    mismatches = rows.select("target_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.kind", "target_id", "x.stored", "x.rebuilt")
    free = relation & ~removed & (F.col("rebuilt") == 0)
    checked = rows.agg(F.count_if(relation).alias("checked_relations"), F.count_if(~relation).alias("checked_entities"), F.count_if(free).alias("evidence_free_relations"), F.coalesce(F.sum(F.size(F.filter(found, lambda x: x.isNotNull()))), F.lit(0)).alias("mismatches"))
    summary = checked.withColumn("consistent", F.col("mismatches") == 0)
    return mismatches, summary


def object_counts(g: Graph, per_document: bool = True) -> DataFrame:
    """doc_id (null: corpus), entities, relations (not removed), objects, rebuild_cost."""
    e = g["entities"].select("doc_id", F.lit(1).alias("e"), F.lit(0).alias("r"))
    r = g["relations"].where(pv.not_removed()).select("doc_id", F.lit(0).alias("e"), F.lit(1).alias("r"))
    both = e.unionByName(r)
    totals = [F.coalesce(F.sum("e"), F.lit(0)).alias("entities"), F.coalesce(F.sum("r"), F.lit(0)).alias("relations")]
    rows = both.groupBy("doc_id").agg(*totals) if per_document else both.agg(*totals).withColumn("doc_id", F.lit(None).cast("string"))
    objects = F.col("entities") + F.col("relations")
    return rows.select("doc_id", "entities", "relations", objects.alias("objects"), (objects * REBUILD_COST).alias("rebuild_cost"))
