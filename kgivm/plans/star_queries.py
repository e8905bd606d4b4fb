"""Queries over the star-schema provenance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import baselines, consistency, evaluation, policy, refresh
from kgivm.operators import provenance as pv
from kgivm.operators.pipeline import apply_batch
from kgivm.sources.star import BATCH_SQL, SQL, star_edits, star_graph
from kgivm.sources.tables import table
from kgivm.staging import pinned

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _edited(g):
    return g["sentences"].where((F.split(F.substring_index("sent_id", ":", -1), "-")[0].cast("long") % 10) == 0).select("sent_id")


@query(SQL + "SELECT relation_id AS target_id, evidence_count::BIGINT AS rebuilt FROM relations")
def active_evidence_count(spark, sf_dir) -> DataFrame:
    return consistency.recomputed(star_graph(spark, sf_dir)).where("target_type = 'relation'").select("target_id", "rebuilt")


AFFECTED = SQL + """, edited AS (SELECT sent_id FROM sentences WHERE o % 10 = 0),
affected AS (SELECT src, 'entity' AS target_type, dst AS target_id, edge_id FROM mentions JOIN edited ON src = sent_id WHERE status <> 'removed'
  UNION ALL SELECT src, 'relation', dst, edge_id FROM supports JOIN edited ON src = sent_id WHERE status <> 'removed')
"""


@query(AFFECTED + "SELECT * FROM affected")
def affected_evidence(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return pv.affected(g, _edited(g))


@query(AFFECTED + "SELECT DISTINCT src, target_type, target_id FROM affected")
def reachable_objects(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return pv.reachable(g, _edited(g))


@query(AFFECTED + "SELECT src, count(*) AS stale_count, count(*)::BIGINT AS cost FROM (SELECT DISTINCT src, target_type, target_id FROM affected) GROUP BY src")
def naive_stale(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return baselines.invalidate(g, _edited(g), 1, dry_run=True).summary.select("src", "stale_count", "cost")


@query(SQL + "SELECT entity_id, name, evidence_count::BIGINT AS evidence_count FROM entities")
def graph_nodes(spark, sf_dir) -> DataFrame:
    return pv.graph_view(star_graph(spark, sf_dir))[0].select("entity_id", "name", "evidence_count")


@query(SQL + "SELECT relation_id, head, rel_type, tail FROM relations WHERE status <> 'removed'")
def graph_edges(spark, sf_dir) -> DataFrame:
    return pv.graph_view(star_graph(spark, sf_dir))[1].select("relation_id", "head", "rel_type", "tail")


@query(SQL + "SELECT relation_id FROM relations WHERE status <> 'removed' AND freshness_status = 'fresh'")
def fresh_only_edges(spark, sf_dir) -> DataFrame:
    return pv.graph_view(star_graph(spark, sf_dir), True)[1].select("relation_id")


@query(SQL + "SELECT relation_id, evidence_count::BIGINT AS evidence_count FROM relations WHERE freshness_status = 'stale'")
def stale_relations(spark, sf_dir) -> DataFrame:
    return pv.stale(star_graph(spark, sf_dir), "relations").select("relation_id", "evidence_count")


PAGE = SQL + """, n AS (SELECT s.sent_id, s.doc_id, count(u.src) AS relation_count FROM sentences s LEFT JOIN supports u ON u.src = s.sent_id AND u.status <> 'removed' GROUP BY ALL) """


def _page(spark, sf_dir, bearing):
    g = star_graph(spark, sf_dir)
    # line items have no index: sentences of a document are paged by id
    g = g.updated(sentences=g["sentences"].withColumn("idx", F.lit(0)).withColumn("doc_id", F.col("sent_id")))
    return pv.evidence_page(g, 200, 100, bearing).select("sent_id", "relation_count")


@query(PAGE + "SELECT sent_id, relation_count FROM n WHERE relation_count > 0 ORDER BY sent_id LIMIT 200 OFFSET 100")
def evidence_sentences_page(spark, sf_dir) -> DataFrame:
    return _page(spark, sf_dir, True)


@query(PAGE + "SELECT sent_id, relation_count FROM n WHERE relation_count = 0 ORDER BY sent_id LIMIT 200 OFFSET 100")
def non_evidence_sentences(spark, sf_dir) -> DataFrame:
    return _page(spark, sf_dir, False)


@query(SQL + "SELECT src AS sent_id, string_agg('supplier ' || s || '|' || rel_type || '|part ' || p, ';' ORDER BY edge_id) AS triples FROM supports JOIN sentences ON src = sent_id WHERE status <> 'removed' GROUP BY src")
def current_triples(spark, sf_dir) -> DataFrame:
    rows = pv.current_triples(star_graph(spark, sf_dir, pinned))
    return rows.select("sent_id", F.array_join(F.transform("triples", lambda t: F.concat_ws("|", t["head"], t["rel_type"], t["tail"])), ";").alias("triples"))


def _batch(spark, sf_dir, mode="immediate"):
    g = star_graph(spark, sf_dir, pinned)
    edits = pinned(star_edits(g, sf_dir))
    return g, edits, apply_batch(g, edits, 1, mode)


@query(BATCH_SQL + "SELECT seq AS edit_seq, scope, delta_type, target_id FROM deltas")
def m1_deltas(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir, "deferred")[2].deltas.select("edit_seq", "scope", "delta_type", "target_id")


@query(BATCH_SQL + "SELECT seq AS edit_seq, CASE scope WHEN 'mention' THEN 'entity' ELSE scope END AS target_type, target_id, decision, cost::INTEGER AS cost FROM costed")
def m2_decisions(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir, "deferred")[2].decisions.select("edit_seq", "target_type", "target_id", "decision", "cost")


@query(
    BATCH_SQL
    + """, net AS (SELECT scope, target_id, sum(CASE delta_type WHEN 'removed' THEN -1 WHEN 'added' THEN 1 ELSE 0 END) AS change, bool_or(decision <> 'SKIP') AS touched FROM decided GROUP BY ALL)
SELECT CASE n.scope WHEN 'mention' THEN 'entity' ELSE n.scope END AS target_type, target_id, (coalesce(s.n, 0) + change)::BIGINT AS evidence_count FROM net n LEFT JOIN start s ON s.scope = n.scope AND s.dst = n.target_id WHERE touched"""
)
def refresh_counts(spark, sf_dir) -> DataFrame:
    r = _batch(spark, sf_dir)[2]
    return r.refreshed.select("target_type", "target_id", "evidence_count").distinct()


@query(
    BATCH_SQL
    + """SELECT scenario::BIGINT AS scenario, count(*) AS decisions, count_if(decision = 'SKIP')::BIGINT AS skip, count_if(decision = 'PATCH')::BIGINT AS patch, count_if(decision = 'REBUILD')::BIGINT AS rebuild, sum(cost)::BIGINT AS cost, CASE WHEN sum(cost) > 0 THEN round(count(*) * 5 / sum(cost), 2) END AS over_ours
FROM costed GROUP BY GROUPING SETS ((scenario), ())"""
)
def scenario_summary(spark, sf_dir) -> DataFrame:
    _, edits, r = _batch(spark, sf_dir, "deferred")
    rows = r.decisions.join(edits.select("edit_seq", "scenario"), "edit_seq")
    n = lambda d: F.count_if(F.col("decision") == d).alias(d.lower())
    out = rows.groupingSets([["scenario"], []], "scenario").agg(F.count("*").alias("decisions"), n("SKIP"), n("PATCH"), n("REBUILD"), F.sum("cost").alias("cost"))
    return out.withColumn("over_ours", tx.ratio(F.col("decisions") * policy.REBUILD_COST, F.col("cost")))


DRIFT = SQL + """, drift AS (SELECT *, CASE WHEN hash_key = 0 THEN evidence_count + 1 ELSE evidence_count END AS stored FROM (SELECT *, length(relation_id) % 2 AS hash_key FROM relations)) """


def _drifted(spark, sf_dir):
    g = star_graph(spark, sf_dir, pinned)
    bad = F.length("relation_id") % 2 == 0
    return g.updated(relations=g["relations"].withColumn("evidence_count", F.col("evidence_count") + F.when(bad, 1).otherwise(0)))


@query(DRIFT + "SELECT 'relation_count' AS kind, relation_id AS target_id, stored::VARCHAR AS stored, evidence_count::VARCHAR AS rebuilt FROM drift WHERE stored <> evidence_count")
def b0_mismatches(spark, sf_dir) -> DataFrame:
    return consistency.check(_drifted(spark, sf_dir))[0]


@query(
    DRIFT
    + """SELECT (SELECT count(*) FROM relations) AS checked_relations, (SELECT count(*) FROM entities) AS checked_entities, 0::BIGINT AS evidence_free_relations, count_if(stored <> evidence_count)::BIGINT AS mismatches, count_if(stored <> evidence_count) = 0 AS consistent FROM drift"""
)
def b0_consistency(spark, sf_dir) -> DataFrame:
    return consistency.check(_drifted(spark, sf_dir))[1]


OBJECTS = SQL + ", objects AS (SELECT doc_id, 1 AS e, 0 AS r FROM entities UNION ALL SELECT doc_id, 0, 1 FROM relations WHERE status <> 'removed') "


@query(OBJECTS + "SELECT doc_id, sum(e)::BIGINT AS entities, sum(r)::BIGINT AS relations, count(*) AS objects, count(*) * 5 AS rebuild_cost FROM objects GROUP BY doc_id")
def doc_rebuild_cost(spark, sf_dir) -> DataFrame:
    return consistency.object_counts(star_graph(spark, sf_dir))


@query(OBJECTS + "SELECT sum(e)::BIGINT AS entities, sum(r)::BIGINT AS relations, count(*) AS objects, count(*) * 5 AS rebuild_cost FROM objects")
def kg_rebuild_cost(spark, sf_dir) -> DataFrame:
    return consistency.object_counts(star_graph(spark, sf_dir), False).drop("doc_id")


@query(SQL + "SELECT rel_type AS label, row_number() OVER (ORDER BY rel_type) - 1 AS position FROM (SELECT DISTINCT rel_type FROM relations WHERE status <> 'removed')")
def ontology_labels(spark, sf_dir) -> DataFrame:
    from kgivm.operators import ontology

    return ontology.labels(star_graph(spark, sf_dir)).select("label", F.col("position").cast("long").alias("position"))


@query("SELECT p_brand AS rel_type, list_aggregate(list_sort(list(DISTINCT p_type)), 'string_agg', ';') AS tails FROM part GROUP BY p_brand")
def alternative_tails(spark, sf_dir) -> DataFrame:
    facts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rel_type"), F.col("p_type").alias("tail"))
    return evaluation.alternative_tails(facts).select("rel_type", F.array_join("tails", ";").alias("tails"))


@query(
    "WITH t AS (SELECT p_brand, p_type FROM part GROUP BY ALL) SELECT p.p_partkey AS fact_id, (SELECT min(t.p_type) FROM t WHERE t.p_brand = p.p_brand AND t.p_type <> p.p_type AND t.p_type <> p.p_name) AS new_tail FROM part p"
)
def replacement_tail(spark, sf_dir) -> DataFrame:
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("head"), F.col("p_brand").alias("rel_type"), F.col("p_type").alias("tail"))
    return evaluation.replacement_tails(facts).select("fact_id", "new_tail")


@query("SELECT o_orderkey, turn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, o_custkey LIMIT 50")
def round_robin_cases(spark, sf_dir) -> DataFrame:
    return evaluation.round_robin(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 50).select("o_orderkey", F.col("turn").cast("long").alias("turn"))


@query(
    """WITH a AS (SELECT l_suppkey AS k, l_linestatus || l_linenumber AS triple FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT l_suppkey AS k, l_linestatus || l_linenumber AS triple FROM lineitem WHERE l_returnflag = 'N')
SELECT k, triple, change, count(*) AS n FROM (SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM a)) GROUP BY ALL"""
)
def triple_multiset_diff(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.concat("l_linestatus", "l_linenumber").alias("triple"), "l_returnflag")
    side = lambda f: rows.where(F.col("l_returnflag") == f)
    return evaluation.triple_diff(side("A"), side("N"), "k").groupBy("k", "triple", "change").agg(F.count("*").alias("n"))


EVENTS = """WITH log AS (SELECT event_type, value, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, CASE event_type WHEN 'click' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'unchanged' END AS delta_type,
  CASE event_type WHEN 'click' THEN 'PATCH' WHEN 'error' THEN 'REBUILD' ELSE 'SKIP' END AS decision, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 5 ELSE 0 END AS cost, user_id, event_id, ts FROM events) """


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    pick = lambda a, b, c: F.when(kind == "click", a).when(kind == "error", b).otherwise(c)
    return e.select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("step"), pick("added", "removed", "unchanged").alias("delta_type"), pick("PATCH", "REBUILD", "SKIP").alias("decision"), pick(1, 5, 0).alias("cost"), "user_id", "event_id", "ts")


@query(EVENTS + "SELECT step, decision, count(*) AS n FROM log GROUP BY ALL")
def log_counts_by_step(spark, sf_dir) -> DataFrame:
    return _log(spark, sf_dir).groupBy("step", "decision").agg(F.count("*").alias("n"))


@query(
    EVENTS
    + """SELECT count_if(delta_type = 'added')::BIGINT AS added, count_if(delta_type = 'removed')::BIGINT AS removed, count_if(delta_type = 'unchanged')::BIGINT AS unchanged, count_if(decision = 'SKIP')::BIGINT AS "SKIP", count_if(decision = 'PATCH')::BIGINT AS "PATCH", count_if(decision = 'REBUILD')::BIGINT AS "REBUILD",
sum(cost)::BIGINT AS actual, count(*) * 5 AS full_rebuild_nominal, 0::BIGINT AS stale_entities, 0::BIGINT AS stale_relations FROM log"""
)
def metrics_summary(spark, sf_dir) -> DataFrame:
    from kgivm.schemas import TABLES
    from kgivm.store import Graph

    log = _log(spark, sf_dir).withColumn("edit_seq", F.col("event_id")).withColumn("position", F.lit(0))
    empty = {t: spark.createDataFrame([], TABLES[t]) for t in ("entities", "relations")}
    return evaluation.metrics_summary(Graph(empty | {"evidence_deltas": log, "refresh_decisions": log}))


@query(
    EVENTS
    + """SELECT event_id, (sum(CASE delta_type WHEN 'added' THEN 1 WHEN 'removed' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step RANGE UNBOUNDED PRECEDING))::BIGINT AS remaining FROM log"""
)
def running_evidence(spark, sf_dir) -> DataFrame:
    change = F.when(F.col("delta_type") == "added", 1).when(F.col("delta_type") == "removed", -1).otherwise(0)
    rows = _log(spark, sf_dir).withColumn("changed", change).withColumn("scope", F.lit("relation")).withColumn("target_id", F.col("user_id")).withColumn("edit_seq", F.col("step"))
    start = spark.createDataFrame([], "scope string, target_id long, active long")
    return policy.ledger(rows, start).select("event_id", "remaining")


@query("SELECT l_orderkey, l_partkey, 'supports_' || left(sha1(l_orderkey || '|' || l_partkey), 16) AS edge_id FROM lineitem GROUP BY ALL")
def safe_keys(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return rows.withColumn("edge_id", tx.edge_key("supports", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")))


@query("SELECT p_partkey, regexp_matches('P' || p_size, '^P[0-9]+$') AS is_id, regexp_matches(p_brand, '^P[0-9]+$') AS brand_is_id FROM part")
def pid_filter(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.is_property_id(F.concat(F.lit("P"), "p_size")).alias("is_id"), tx.is_property_id(F.col("p_brand")).alias("brand_is_id"))


@query(
    BATCH_SQL
    + """, net AS (SELECT target_id, sum(CASE delta_type WHEN 'removed' THEN -1 WHEN 'added' THEN 1 ELSE 0 END) AS change, bool_or(decision <> 'SKIP') AS touched FROM decided WHERE scope = 'relation' GROUP BY ALL)
SELECT r.relation_id FROM relations r JOIN net n ON n.target_id = r.relation_id WHERE r.status <> 'removed' AND n.touched AND r.evidence_count + n.change = 0"""
)
def refreshed_removals(spark, sf_dir) -> DataFrame:
    g, _, r = _batch(spark, sf_dir)
    live = g["relations"].where("status <> 'removed'").select("relation_id")
    return r.graph["relations"].where("status = 'removed'").select("relation_id").join(live, "relation_id", "left_semi")


def refresh_is_idempotent(graph) -> bool:
    return refresh.apply_refreshes(graph).refreshed.isEmpty()
