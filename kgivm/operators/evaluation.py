"""Counts, ratios and ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import provenance as pv
from kgivm.operators.policy import REBUILD_COST
from kgivm.store import Graph


def log_counts(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(field).agg(F.count("*").alias("n"))


def metrics_summary(g: Graph, step: int | None = None) -> DataFrame:
    """One row: delta and decision counts, costs of a step (or all), stale objects of any step."""
    deltas, decisions = (pv.logged(g, t, step) for t in ("evidence_deltas", "refresh_decisions"))
    d = deltas.agg(*(F.count_if(F.col("delta_type") == x).alias(x) for x in ("added", "removed", "unchanged")))
    c = decisions.agg(*(F.count_if(F.col("decision") == x).alias(x) for x in ("SKIP", "PATCH", "REBUILD")), F.coalesce(F.sum("cost"), F.lit(0)).alias("actual"), (F.count("*") * REBUILD_COST).alias("full_rebuild_nominal"))
    stale = [g[t].agg(F.count_if(F.col("freshness_status") == "stale").alias(f"stale_{t}")) for t in ("entities", "relations")]
    return d.crossJoin(c).crossJoin(stale[0]).crossJoin(stale[1])


def alternative_tails(facts: DataFrame) -> DataFrame:
    """rel_type, tails: sorted distinct tails."""
    return facts.groupBy("rel_type").agg(F.array_sort(F.collect_set("tail")).alias("tails"))


def replacement_tails(facts: DataFrame) -> DataFrame:
    """``facts`` (fact_id, head, rel_type, tail) with the first other tail of the type that is not the head."""
    rows = facts.join(alternative_tails(facts), "rel_type")
    return rows.withColumn("new_tail", F.try_element_at(F.filter("tails", lambda t: (t != F.col("tail")) & (t != F.col("head"))), F.lit(1))).drop("tails")


def round_robin(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The first row of every group, then the second ..., up to ``limit`` (a sampling report)."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def confusion(rows: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy (0.0 for a zero denominator). A missing prediction is False."""
    p, a = F.coalesce(predicted, F.lit(False)), F.col(actual)
    out = rows.where(a.isNotNull()).groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return measures(out)


def measures(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn, tn) with precision, recall, f1, accuracy."""
    out = counts.withColumn("precision", tx.share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", tx.share(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", tx.share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", tx.share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def ranking(ranked: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit@k and mean reciprocal rank. ``ranked``: query_id, rank, relevant; queries without a relevant row count 0."""
    first = ranked.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.select("query_id").distinct().join(first, "query_id", "left")
    hits = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    return rows.agg(F.count("*").alias("queries"), *hits, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Micro-averaged counts and measures per threshold. ``scored``: score, relevant. Each row is counted once for every threshold inside one aggregation."""
    at = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    rows = scored.select("score", "relevant", at)
    return confusion(rows.withColumn("predicted", F.col("score") >= F.col("threshold")), "predicted", "relevant", "threshold")


def triple_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Multiset differences of (key, triple) rows both ways: change ('removed', 'added'), one row per surplus copy."""
    columns = [key, "triple"]
    gone = before.select(*columns).exceptAll(after.select(*columns)).withColumn("change", F.lit("removed"))
    return gone.unionByName(after.select(*columns).exceptAll(before.select(*columns)).withColumn("change", F.lit("added")))


def scenario_summary(rows: DataFrame) -> DataFrame:
    """Totals per scenario and over all (scenario null) with cost ratios, null where ours is 0."""
    sums = ["affected_mentions", "affected_relations", "added", "removed", "unchanged", "skip", "patch", "rebuild", "ours_cost", "full_rebuild_cost", "ours_stale", "b1_reachable", "naive_stale", "document_cost", "whole_kg_cost"]
    out = rows.groupingSets([["scenario"], []], "scenario").agg(F.count("*").alias("edits"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    ratios = {"b1_over_ours": ("b1_reachable", "ours_stale"), "b2_over_ours": ("naive_stale", "ours_stale"), "document_over_ours": ("document_cost", "ours_cost"), "whole_kg_over_ours": ("whole_kg_cost", "ours_cost")}
    return out.withColumns({k: tx.ratio(F.col(a), F.col(b)) for k, (a, b) in ratios.items()})


def rates(summary: DataFrame) -> DataFrame:
    """Shares of decisions and the saving against a rebuild."""
    n = F.col("skip") + F.col("patch") + F.col("rebuild")
    return summary.withColumns({"skip_rate": tx.share(F.col("skip"), n), "patch_rate": tx.share(F.col("patch"), n), "rebuild_rate": tx.share(F.col("rebuild"), n), "cost_reduction": F.when(F.col("full_rebuild_cost") != 0, 1 - F.col("ours_cost") / F.col("full_rebuild_cost")).otherwise(F.lit(0.0))})


def label_flags(rows: DataFrame, text: str = "text", old: str = "old_value", label: str = "should_edit", provenance: str = "supports") -> DataFrame:
    """Suspicious labels: FLAG-1 to be edited without the value in its text, FLAG-2 not to be edited though text and provenance hold it."""
    holds = F.contains(tx.label_norm(F.col(text)), tx.label_norm(F.col(old)))
    flag = F.when(F.col(label) & ~holds, "FLAG-1").when(~F.col(label) & holds & F.col(provenance), "FLAG-2")
    return rows.withColumn("flag", flag)


def reviewed(labels: DataFrame, reviews: DataFrame, *keys: str) -> DataFrame:
    """Labels with reviewed values put over suggestions."""
    rows = labels.join(reviews.select(*keys, F.col("should_edit").alias("_seen"), F.col("notes").alias("_notes")), list(keys), "left")
    return rows.withColumn("human_should_edit", F.coalesce("_seen", "suggested_should_edit")).withColumn("human_notes", F.coalesce("_notes", F.lit(""))).drop("_seen", "_notes")


def candidates(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Evidence and retrieved sentences of each case, best score first, then id; rank and score are null for those not retrieved."""
    both = evidence.withColumn("supports", F.lit(True)).join(retrieved, ["case_id", "sentence_id"], "full_outer")
    both = both.withColumn("supports", F.coalesce("supports", F.lit(False)))
    order = Window.partitionBy("case_id").orderBy(F.coalesce("score", F.lit(float("-inf"))).desc(), F.col("sentence_id").desc())
    return both.withColumn("position", F.row_number().over(order))


def mean_flags(rows: DataFrame, *flags: str) -> DataFrame:
    """Averages of boolean columns: stage accuracies."""
    return rows.agg(F.count("*").alias("operations"), *(F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in flags))


def edit_outcomes(result, cases: DataFrame) -> DataFrame:
    """Per case whether its edit removed the old fact, added the new one, and decided as the evidence asks for. ``cases``: edit_seq, old and new (triples), active_before (of the old relation). The old relation is rebuilt if it had one evidence only; the new one is patched."""
    norm = lambda t: F.concat_ws("|", *(tx.normalize_name(F.col(f"{t}.{c}")) for c in ("head", "rel_type", "tail")))
    done = result.deltas.where("scope = 'relation'").select("edit_seq", "delta_type", "target_id", norm("triple").alias("fact"))
    done = done.join(result.decisions.where("target_type = 'relation'").select("edit_seq", "target_id", "decision").distinct(), ["edit_seq", "target_id"])
    both = cases.withColumn("old_fact", norm("old")).withColumn("new_fact", norm("new")).join(done, "edit_seq", "left")
    is_old = (F.col("fact") == F.col("old_fact")) & (F.col("delta_type") == "removed")
    is_new = (F.col("fact") == F.col("new_fact")) & (F.col("delta_type") == "added")
    expected = F.when(F.col("active_before") == 1, "REBUILD").otherwise("PATCH")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rows = both.groupBy("edit_seq").agg(some(is_old).alias("old_removed"), some(is_new).alias("new_added"), some(is_old & (F.col("decision") == expected)).alias("old_decision"), some(is_new & (F.col("decision") == "PATCH")).alias("new_decision"))
    return rows.withColumn("delta_correct", F.col("old_removed") & F.col("new_added")).withColumn("decision_correct", F.col("old_decision") & F.col("new_decision"))


def per_edit(seconds: Column, edits: Column, records: Column) -> dict[str, Column]:
    return {"ms_per_edit": tx.ratio(seconds * 1000, edits), "records_per_edit": tx.ratio(records, edits)}
