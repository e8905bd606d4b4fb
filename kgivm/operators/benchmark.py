"""Deterministic edit workloads and their comparison with the baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import consistency, evaluation
from kgivm.operators import provenance as pv
from kgivm.operators.pipeline import BatchResult, apply_batch
from kgivm.schemas import TRIPLES
from kgivm.store import Graph


def removal_phrase(text: Column, triples: Column) -> Column:
    """Of the endpoints in the text, the one that stands last; then the one in fewest triples, the longest, the greatest."""
    ends = F.flatten(F.transform(triples, lambda t: F.array(t["tail"], t["head"])))
    inside = F.filter(ends, lambda p: F.coalesce((p != "") & tx.phrase_occurs(text, p), F.lit(False)))
    # length up to the last occurrence
    last = lambda p: F.length(text) - F.length(F.call_function("substring_index", text, p, F.lit(-1))) - F.length(p)
    touched = lambda p: F.size(F.filter(triples, lambda t: (t["head"] == p) | (t["tail"] == p)))
    best = F.array_max(F.transform(inside, lambda p: F.struct(last(p).alias("at"), (-touched(p)).alias("touched"), F.length(p).alias("size"), p.alias("phrase"))))
    return best["phrase"]


def workload(g: Graph, per_scenario: int, start_step: int = 1) -> DataFrame:
    """edit_seq, scenario and edits of four disjoint groups of sentences: unchanged, a relation removed, a tail changed, no relation evidence."""
    names = ("semantic_noop", "remove_relation", "change_relation_tail")
    with_rel = pv.evidence_page(g, 3 * per_scenario)
    order = F.row_number().over(pv.Window.orderBy("doc_id", "idx")) - 1
    groups = with_rel.withColumn("at", order).withColumn("group", F.floor(F.col("at") / per_scenario).cast("int"))
    rest = pv.evidence_page(g, per_scenario, bearing=False).withColumn("at", order).withColumn("group", F.lit(3))
    rows = groups.unionByName(rest).join(pv.current_triples(g), "sent_id", "left").withColumn("triples", F.coalesce("triples", F.array().cast(TRIPLES)))
    rows = rows.where((F.size("triples") > 0) | F.col("group").isin(0, 3))
    step = F.row_number().over(pv.Window.orderBy("group", "doc_id", "idx")) - 1 + start_step
    rows = rows.withColumn("step", step).withColumn("scenario", F.element_at(F.array(*map(F.lit, (*names, "no_relation_evidence"))), F.col("group") + 1))
    text, triples = F.col("text"), F.col("triples")
    phrase = removal_phrase(text, triples)
    rows = rows.withColumn("phrase", phrase)
    removed_text = F.when(F.col("phrase").isNotNull(), tx.remove_phrase(text, F.col("phrase"))).otherwise(F.concat("text", F.lit(" [benchmark relation removed]")))
    removed = F.when(F.col("phrase").isNotNull(), F.filter(triples, lambda t: (t["head"] != F.col("phrase")) & (t["tail"] != F.col("phrase")))).otherwise(F.slice(triples, 2, F.greatest(F.size(triples) - 1, F.lit(0))))
    occurring = F.filter(triples, lambda t: F.coalesce(tx.phrase_occurs(text, t["tail"]), F.lit(False)))
    rows = rows.withColumn("chosen", F.coalesce(F.get(occurring, F.lit(0)), F.get(triples, F.lit(0)))).withColumn("new_tail", F.concat(F.lit("Benchmark Entity "), F.col("step")))
    changed = F.transform(triples, lambda t: F.when(t == F.col("chosen"), F.struct(t["head"].alias("head"), t["rel_type"].alias("rel_type"), F.col("new_tail").alias("tail"))).otherwise(t))
    tail = F.col("chosen.tail")
    changed_text = F.when(tx.phrase_occurs(text, tail), tx.replace_phrase(text, tail, F.col("new_tail"))).otherwise(F.concat("text", F.lit(" "), F.col("new_tail"), F.lit(".")))
    which = F.col("scenario")
    new_text = F.when(which == "remove_relation", removed_text).when(which == "change_relation_tail", changed_text).otherwise(F.concat("text", F.lit(" ")))
    intended = F.when(which == "remove_relation", removed).when(which == "change_relation_tail", changed).when(which == "semantic_noop", triples).otherwise(F.slice(triples, 1, 0))
    return rows.select((F.col("step") - start_step).cast("long").alias("edit_seq"), "scenario", "sent_id", "doc_id", F.col("idx").alias("sent_idx"), new_text.alias("new_text"), intended.alias("intended_triples"), F.col("triples").alias("before_triples"))


def compare(g: Graph, work: DataFrame, step: int = 1) -> tuple[BatchResult, DataFrame]:
    """Apply a workload; per edit its own costs and those of the baselines, measured on the graph before the edits."""
    result = apply_batch(g, work.select("edit_seq", "doc_id", "sent_idx", "new_text", "intended_triples"), step)
    reach = pv.reachable(g, work.select("sent_id")).groupBy("src").agg(F.count("*").alias("b1_reachable"))
    edges = pv.affected(g, work.select("sent_id")).groupBy("src").agg(F.count_if(F.col("target_type") == "entity").alias("affected_mentions"), F.count_if(F.col("target_type") == "relation").alias("affected_relations"))
    docs = consistency.object_counts(g).select("doc_id", F.col("rebuild_cost").alias("document_cost"))
    whole = consistency.object_counts(g, False).select(F.col("rebuild_cost").alias("whole_kg_cost"))
    deltas = result.deltas.groupBy("edit_seq").agg(*(F.count_if(F.col("delta_type") == x).alias(x) for x in ("added", "removed", "unchanged")))
    decisions = result.decisions.groupBy("edit_seq").agg(*(F.count_if(F.col("decision") == x).alias(x.lower()) for x in ("SKIP", "PATCH", "REBUILD")), F.sum("cost").alias("ours_cost"), F.count_if(F.col("decision") != "SKIP").alias("ours_stale"))
    rows = work.join(reach.withColumnRenamed("src", "sent_id"), "sent_id", "left").join(edges.withColumnRenamed("src", "sent_id"), "sent_id", "left").join(docs, "doc_id", "left").crossJoin(F.broadcast(whole))
    rows = rows.join(deltas, "edit_seq", "left").join(decisions, "edit_seq", "left")
    numbers = ["b1_reachable", "affected_mentions", "affected_relations", "added", "removed", "unchanged", "skip", "patch", "rebuild", "ours_cost", "ours_stale", "document_cost", "whole_kg_cost"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    n = F.col("skip") + F.col("patch") + F.col("rebuild")
    return result, rows.withColumn("naive_stale", F.col("b1_reachable")).withColumn("full_rebuild_cost", n * consistency.REBUILD_COST)


def triples_changed(work: DataFrame) -> DataFrame:
    """Per edit the triples that its intended set lost and gained."""
    each = lambda c: work.select("edit_seq", F.explode(c).alias("triple"))
    return evaluation.triple_diff(each("before_triples"), each("intended_triples"), "edit_seq")


def decision_audit(result: BatchResult) -> DataFrame:
    """Decisions with their targets as they are after the refresh; a missing target is marked."""
    e = result.graph["entities"].select(F.lit("entity").alias("target_type"), F.col("entity_id").alias("target_id"), F.col("name").alias("label"), "evidence_count", "freshness_status", F.lit(None).cast("string").alias("target_status"))
    names = result.graph["entities"].select("entity_id", "name")
    r = result.graph["relations"].join(names.withColumnsRenamed({"entity_id": "head", "name": "h"}), "head", "left").join(names.withColumnsRenamed({"entity_id": "tail", "name": "t"}), "tail", "left")
    r = r.select(F.lit("relation").alias("target_type"), F.col("relation_id").alias("target_id"), F.concat_ws(" | ", F.coalesce("h", "head"), "rel_type", F.coalesce("t", "tail")).alias("label"), "evidence_count", "freshness_status", F.col("status").alias("target_status"))
    rows = result.decisions.join(e.unionByName(r), ["target_type", "target_id"], "left")
    return rows.withColumn("missing", F.col("freshness_status").isNull())
