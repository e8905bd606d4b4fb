import pytest
from pyspark.sql import functions as F

from kgivm.operators import baselines, consistency, evaluation
from kgivm.operators import provenance as pv
from kgivm.store import Graph


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("kind", ["naive", "traversal", "update"])
def test_baselines(store, spark, edits, kind):
    g = store.load()
    got = baselines.invalidate(g, spark.createDataFrame([("doc0:0",)], "s string"), 4, kind, max_depth=3)
    s = got.summary.first()
    assert (s.stale_entities, s.stale_relations, s.stale_count, s.cost) == (["doc0:e0", "doc0:e1", "doc0:e2"], ["doc0:r0"], 4, 4)
    assert rows(got.graph["entities"], "entity_id", "freshness_status", "last_changed_step")[0] == ("doc0:e0", "stale", 4)
    dry = baselines.invalidate(g, spark.createDataFrame([("doc0:0",)], "s string"), 4, kind, dry_run=True)
    assert dry.graph is g
    graph, cost = baselines.run_edits(g, edits(("doc0", 0, "new text", [])), 4, kind)
    assert rows(cost, "this_step", "vs_full_rebuild") == [(4, 4)]
    assert graph["sentences"].where("sent_id = 'doc0:0'").first().text == "new text"
    with pytest.raises(ValueError):
        baselines.invalidate(g, spark.createDataFrame([("x",)], "s string"), 1, "other")


def test_consistency_finds_drift(store):
    g = store.load()
    mismatches, summary = consistency.check(g, require_fresh=True)
    assert summary.first().consistent and mismatches.count() == 0
    bad = g.updated(relations=g["relations"].withColumn("evidence_count", F.when(F.col("relation_id") == "doc0:r0", 999).otherwise(F.col("evidence_count"))))
    mismatches, summary = consistency.check(bad)
    assert rows(mismatches, "kind", "target_id", "stored", "rebuilt") == [("relation_count", "doc0:r0", "999", "1")] and not summary.first().consistent
    assert consistency.check(bad, "doc1")[1].first().checked_relations == 0
    gone = g.updated(relations=g["relations"].withColumn("status", F.lit("removed")), entities=g["entities"].withColumn("freshness_status", F.lit("stale")))
    kinds = [r[0] for r in rows(consistency.check(gone, require_fresh=True)[0], "kind")]
    assert kinds == ["relation_status"] * 3 + ["stale"] * 4


def test_rebuild_costs(store):
    g = store.load()
    doc, whole = consistency.object_counts(g).first(), consistency.object_counts(g, False).first()
    assert (doc.objects, doc.rebuild_cost, whole.rebuild_cost) == (7, 35, 35)


def test_pages_and_lookups(store):
    g = store.load()
    assert rows(pv.evidence_page(g, 1, 1), "sent_id", "relation_count") == [("doc0:1", 2)]
    assert pv.evidence_page(g, 5, bearing=False).count() == 0
    with pytest.raises(ValueError):
        pv.sentence(g, "doc9", 0)
    assert dict(rows(pv.counts(g), "name", "rows"))["entities"] == 4
    assert [r.triples[0].asDict() for r in pv.current_triples(g).orderBy("sent_id").collect()][0] == {"head": "Aurelia", "rel_type": "manufacturer", "tail": "Lindqvist Yard"}


def test_metrics(store):
    m = evaluation.metrics_summary(store.load()).first()
    assert (m.added, m.SKIP, m.actual, m.full_rebuild_nominal, m.stale_entities) == (0, 0, 0, 0, 0)


def test_measures(spark):
    c = evaluation.confusion(spark.createDataFrame([(True, True), (None, True), (False, False), (True, None)], "p boolean, a boolean"), "p", "a").first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision, c.recall, round(c.f1, 4)) == (1, 0, 1, 1, 1.0, 0.5, 0.6667)
    none = evaluation.confusion(spark.createDataFrame([], "p boolean, a boolean"), "p", "a").first()
    assert (none.precision, none.f1, none.accuracy) == (0.0, 0.0, 0.0)
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, False)], "query_id int, rank int, relevant boolean")
    r = evaluation.ranking(ranked, ranked).first()
    assert (r.queries, round(r.hit_1, 4), round(r.hit_3, 4), r.mrr) == (3, 0.3333, 0.6667, 0.5)
    flags = evaluation.label_flags(spark.createDataFrame([("x", "a", True, True), ("a b", "A.", False, True), ("a", "a", True, False)], "text string, old_value string, should_edit boolean, supports boolean"))
    assert [f.flag for f in flags.collect()] == ["FLAG-1", "FLAG-2", None]


def test_triple_diff_is_a_multiset(spark):
    t = lambda *x: spark.createDataFrame([(1, v) for v in x], "k int, triple string")
    assert rows(evaluation.triple_diff(t("a", "a", "b"), t("a", "c"), "k"), "triple", "change") == [("a", "removed"), ("b", "removed"), ("c", "added")]


def test_empty_graph(spark):
    from kgivm.schemas import TABLES

    g = Graph({t: spark.createDataFrame([], s) for t, s in TABLES.items()})
    assert pv.graph_view(g)[0].count() == 0 and consistency.check(g)[1].first().consistent
