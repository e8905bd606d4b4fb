from pyspark.sql import functions as F

from kgivm.operators import consistency, editor
from kgivm.operators import provenance as pv
from kgivm.operators.pipeline import EDGES, apply_batch, touched
from kgivm.operators.sift import key, sift
from kgivm.sources.star import star_graph
from kgivm.staging import pinned


def test_a_bitmap_lets_through_all_of_its_keys_and_few_others(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    few = rows.where("k like '%7'")
    s = sift(few.select(key("k")), spark.createDataFrame([], "h long"))
    through, rest = s.through(rows, key("k")), s.rest(rows, key("k"))
    assert through.join(few, "k", "left_semi").count() == few.count() == 2000
    assert through.count() < 4500 and through.count() + rest.count() == 20_001 and through.intersect(rest).count() == 0
    assert sift(spark.createDataFrame([], "h long")).through(rows, key("k")).count() == 0


def test_a_batch_touches_few_rows_of_a_large_graph(spark, store, edits):
    """Documents that the edits do not name are not joined, and come out as they went in."""
    g = store.load()
    copies = spark.range(1, 1500).select(F.concat(F.lit("doc"), "id").alias("d"))
    ids = {"sentences": ["sent_id", "doc_id"], "entities": ["entity_id", "doc_id"], "relations": ["relation_id", "doc_id", "head", "tail"], "mentions": ["edge_id", "src", "dst"], "sentence_supports_relation": ["edge_id", "src", "dst"]}
    other = lambda c: F.regexp_replace(c, F.lit("^doc0"), F.col("d")) if c != "edge_id" else F.concat("d", "edge_id")
    big = g.updated(**{t: pinned(g[t].unionByName(g[t].crossJoin(copies).withColumns({c: other(c) for c in cs}).drop("d"))) for t, cs in ids.items()})
    found = edits(("doc0", 0, "Aurelia is moored at Norrhamn.", [("Aurelia", "moored at", "Norrhamn")])).withColumn("sent_id", F.lit("doc0:0"))
    few, rest = touched(big, found, lambda df: df)
    for t in ids:
        assert few[t].count() < 300 and few[t].count() + rest[t].count() == big[t].count() == 1500 * g[t].count()
    a, b = apply_batch(g, found, 1), apply_batch(big, found, 1)
    assert sorted(map(str, a.decisions.collect())) == sorted(map(str, b.decisions.collect())) and sorted(map(str, a.refreshed.collect())) == sorted(map(str, b.refreshed.collect()))
    for t in (*EDGES, "entities", "relations"):
        assert sorted(map(str, a.graph[t].exceptAll(g[t]).collect())) == sorted(map(str, b.graph[t].exceptAll(big[t]).collect()))


def test_the_star_graph_is_moved_once(spark, tmp_path):
    data = [(1, 2, 3, 1, "R", "O"), (1, 2, 3, 1, "N", "O"), (1, 2, 3, 1, "R", "F"), (1, 2, 3, 2, "R", "F"), (10, 2, 4, 1, "R", "F")]
    spark.createDataFrame(data, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = star_graph(spark, str(tmp_path))
    for t in ("relations", "mentions", "sentences", "sentence_supports_relation"):
        assert g[t]._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + g[t]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.relation_id, r.evidence_count, r.freshness_status, r.status) for r in g["relations"].collect()) == [("doc2:r3_F", 0, "stale", "removed"), ("doc2:r3_O", 1, "fresh", "active"), ("doc2:r4_F", 0, "stale", "removed")]
    assert sorted((r.entity_id, r.evidence_count, r.freshness_status) for r in g["entities"].collect()) == [("doc2:e3", 1, "stale"), ("doc2:e4", 0, "stale"), ("doc2:e_s", 0, "fresh")]
    assert sorted((r.edge_id, r.status) for r in g["mentions"].collect()) == [("doc2:1-1-3#m", "active"), ("doc2:1-2-3#m", "removed"), ("doc2:10-1-4#m", "removed")]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_each_table_is_read_once(store):
    g = store.load()
    assert scans(consistency.check(g)[1]) == scans(consistency.check(g)[0]) == 4
    assert scans(pv.current_triples(g)) == 4  # the edges, their relations, and the names of both ends


def test_evidence_is_looked_up_for_few_sentences(spark, store):
    g = store.load()
    asked = spark.createDataFrame([(1, "doc0", "remove Norrhamn"), (2, "doc0", "what of Lindqvist Yard?"), (3, "doc9", "remove Aurelia")], "instruction_id long, doc_id string, instruction string")
    got = editor.select_by_evidence(g, asked)
    assert sorted(map(tuple, got.collect())) == [(1, "doc0:0"), (1, "doc0:1"), (2, "doc0:0")]
    few = pv.around(g, spark.createDataFrame([("doc0:1",)], "s string"))
    assert few["mentions"].count() == 2 and few["sentence_supports_relation"].count() == 2 and few["relations"].count() == 2 and few["entities"].count() == 3
