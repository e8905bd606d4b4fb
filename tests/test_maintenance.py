import hashlib

import pytest
from pyspark.sql import functions as F

from kgivm.operators import provenance as pv
from kgivm.operators.pipeline import apply_batch, run_batch, run_strict, tick
from kgivm.store import Store

MADE, MOORED = ("Aurelia", "manufacturer", "Lindqvist Yard"), ("Aurelia", "moored at", "Norrhamn")


def digest(text):
    return hashlib.sha1(text.encode()).hexdigest()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ingest(store, spark):
    g = store.load()
    assert rows(g["sentences"], "sent_id", "text_hash")[1] == ("doc0:1", digest("Norrhamn lies on Lake Vetter ."))
    assert rows(g["entities"], "entity_id", "norm_name", "evidence_count") == [("doc0:e0", "aurelia", 2), ("doc0:e1", "lindqvist yard", 1), ("doc0:e2", "norrhamn", 2), ("doc0:e3", "lake vetter", 2)]
    assert rows(g["relations"], "relation_id", "head", "tail", "rel_type", "evidence_count") == [
        ("doc0:r0", "doc0:e0", "doc0:e1", "manufacturer", 1), ("doc0:r1", "doc0:e2", "doc0:e3", "lies by", 1), ("doc0:r2", "doc0:e0", "doc0:e3", "P9001", 2),
    ]
    one = spark.createDataFrame([("doc0:1",)], "s string")
    assert rows(pv.affected(g, one), "target_id") == [("doc0:e2",), ("doc0:e3",), ("doc0:r1",), ("doc0:r2",)]
    nodes, edges = pv.graph_view(g)
    assert (nodes.count(), edges.count()) == (4, 3)


def test_paraphrase_skips(store, edits):
    r = apply_batch(store.load(), edits(("doc0", 0, "At Norrhamn the Lindqvist Yard made Aurelia.", [MADE])), 1)
    assert rows(r.deltas, "scope", "delta_type") == [("mention", "unchanged")] * 3 + [("relation", "unchanged")]
    assert rows(r.decisions, "decision", "cost") == [("SKIP", 0)] * 4
    assert r.marked_stale.count() == 0 and r.graph["entities"].where("freshness_status <> 'fresh'").count() == 0


def test_change_of_relation(store, edits):
    r = run_batch(store, edits(("doc0", 0, "Aurelia is moored at Norrhamn.", [MOORED])))
    made = "doc0:r_auto_" + digest("doc0:e0|moored at|doc0:e2")[:16]
    assert rows(r.decisions, "decision", "target_id") == [("PATCH", made), ("REBUILD", "doc0:e1"), ("REBUILD", "doc0:r0"), ("SKIP", "doc0:e0"), ("SKIP", "doc0:e2")]
    e = r.edits.first()
    assert (e.this_step, e.vs_full_rebuild, e.old_text) == (11, 25, "Lindqvist Yard built the ferry Aurelia in Norrhamn .")
    g = r.graph
    assert rows(g["relations"].where("relation_id = 'doc0:r0'"), "status", "freshness_status", "evidence_count", "last_changed_step") == [("removed", "fresh", 0, 1)]
    edge = "supports_" + digest(f"doc0:0|{made}")[:16]
    assert rows(g["sentence_supports_relation"].where("added_step = 1"), "edge_id", "status") == [(edge, "active")]
    assert g["refresh_decisions"].where("status <> 'applied'").count() == 0 and g.step == 1
    assert rows(g["entities"], "entity_id", "evidence_count") == [("doc0:e0", 2), ("doc0:e1", 0), ("doc0:e2", 2), ("doc0:e3", 2)]


def test_edits_of_a_batch_see_earlier_ones(store, edits):
    batch = edits(("doc0", 1, "It lies by the water.", []), ("doc0", 2, "Aurelia rests all summer.", []))
    r = run_batch(store, batch, "deferred")
    got = {(x.edit_seq, x.target_id): x.decision for x in r.decisions.collect()}
    # the first edit leaves one evidence of e3 and of r2, the second one takes it
    assert got == {
        (0, "doc0:e2"): "PATCH", (0, "doc0:e3"): "PATCH", (0, "doc0:r1"): "REBUILD", (0, "doc0:r2"): "PATCH",
        (1, "doc0:e0"): "SKIP", (1, "doc0:e3"): "REBUILD", (1, "doc0:r2"): "REBUILD",
    }
    assert rows(r.graph["relations"], "relation_id", "status", "freshness_status") == [("doc0:r0", "active", "fresh"), ("doc0:r1", "active", "stale"), ("doc0:r2", "active", "stale")]
    assert tick(store, only="SKIP").skipped.count() == 1
    t = tick(store)
    assert rows(t.refreshed, "target_id", "decision", "evidence_count") == [
        ("doc0:e2", "PATCH", 1), ("doc0:e3", "PATCH", 0), ("doc0:e3", "REBUILD", 0), ("doc0:r1", "REBUILD", 0), ("doc0:r2", "PATCH", 0), ("doc0:r2", "REBUILD", 0),
    ]
    assert rows(store.load()["relations"], "relation_id", "status") == [("doc0:r0", "active"), ("doc0:r1", "removed"), ("doc0:r2", "removed")]
    assert tick(store).refreshed.count() == 0


def test_new_names_and_two_edits_of_one_sentence(store, edits):
    batch = edits(
        ("doc0", 0, "Sigrid met Aurelia in Norrhamn.", [("Sigrid", "met", "Aurelia")]), ("doc0", 0, "Norrhamn employs Sigrid.", [("Norrhamn", "employs", "Sigrid")]), ("doc0", 2, "Lake Vetter pleases Sigrid.", [("Sigrid", "likes", "Lake Vetter")]),
    )
    r = apply_batch(store.load(), batch, 3)
    got = {(x.edit_seq, x.scope, x.delta_type, x.triple.entity or x.triple.rel_type) for x in r.deltas.collect()}
    assert got == {
        (0, "mention", "unchanged", "Aurelia"), (0, "mention", "unchanged", "Norrhamn"), (0, "mention", "removed", "Lindqvist Yard"), (0, "mention", "added", "Sigrid"), (0, "relation", "added", "met"), (0, "relation", "removed", "manufacturer"),
        (1, "mention", "removed", "Aurelia"), (1, "mention", "unchanged", "Norrhamn"), (1, "mention", "unchanged", "Sigrid"), (1, "relation", "removed", "met"), (1, "relation", "added", "employs"),
        # Sigrid exists by then, so the last edit attaches no mention of her
        (2, "mention", "removed", "Aurelia"), (2, "mention", "unchanged", "Lake Vetter"), (2, "relation", "removed", "P9001"), (2, "relation", "added", "likes"),
    }
    assert r.graph["sentences"].where("sent_id = 'doc0:0'").first().text == "Norrhamn employs Sigrid."
    assert r.edits.where("edit_seq = 1").first().old_text == "Sigrid met Aurelia in Norrhamn."


def test_unknown_sentence_and_mode(store, edits):
    r = apply_batch(store.load(), edits(("doc9", 9, "x", [])), 1)
    e = r.edits.first()
    assert (e.sentence_found, e.this_step, e.old_text) == (False, 0, None) and r.deltas.count() == 0
    with pytest.raises(ValueError):
        run_batch(store, edits(("doc0", 0, "x", [])), "never")
    assert store.load().step == 0


def test_strict_equals_batch_state(store, spark, edits, tmp_path):
    other = Store(spark, f"file://{tmp_path}/other")
    store.clone(other.path)
    batch = edits(("doc0", 0, "Lindqvist Yard and Aurelia", [MADE]), ("doc0", 1, "Lake Vetter", []))
    run_batch(store, batch)
    results = run_strict(other, batch)
    assert [r.graph.step for r in results] == [1, 2]
    a, b = store.load(), other.load()
    for t, key in (("entities", "entity_id"), ("relations", "relation_id")):
        assert rows(a[t], key, "evidence_count") == rows(b[t], key, "evidence_count")


def test_clone_is_independent_and_old_snapshots_go(store, spark, edits, tmp_path):
    other = Store(spark, f"file://{tmp_path}/twin")
    store.clone(other.path)
    assert other.vacuum() == 0
    run_batch(other, edits(("doc0", 1, "Lake Vetter", [])))
    assert other.vacuum(keep=2) == 0 and other.vacuum() > 0 and other.vacuum() == 0
    store.drop()
    assert other.load()["sentences"].where("text = 'Lake Vetter'").count() == 1 and other.load().step == 1


def test_status_null_is_followed_but_not_counted(store, edits):
    g = store.load()
    g = g.updated(mentions=g["mentions"].withColumn("status", F.lit(None).cast("string")))
    r = apply_batch(g, edits(("doc0", 0, "nothing", [])), 1)
    assert rows(r.decisions.where("target_type = 'entity'"), "decision") == [("REBUILD",)] * 3


def test_store(store, spark):
    g = store.load()
    assert store.append(g, "documents", g["documents"].where("false")) is g
    assert store.append(g, "documents", g["documents"])["documents"].count() == 2
    assert store.clear()["documents"].count() == 0
    store.drop()
    assert not store.exists() and store.init()["entities"].count() == 0
