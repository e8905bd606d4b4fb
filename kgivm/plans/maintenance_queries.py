"""Queries over reads, logs, labels, rewriting and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import editor, evaluation, ontology, retrieval, vector_index
from kgivm.operators import provenance as pv
from kgivm.plans.star_queries import AFFECTED, EVENTS, _batch, _edited, _log
from kgivm.sources.star import BATCH_SQL, SQL, star_graph
from kgivm.sources.tables import table
from kgivm.staging import pinned, staging_path
from kgivm.store import Graph

QUERIES, ORACLES = {}, {}
TARGET = "CASE scope WHEN 'mention' THEN 'entity' ELSE scope END AS target_type"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(SQL + "SELECT sent_id, doc_id, text, sha1(text) AS text_hash FROM sentences")
def sentence_list(spark, sf_dir) -> DataFrame:
    return pv.sentences(star_graph(spark, sf_dir)).select("sent_id", "doc_id", "text", "text_hash")


@query(SQL + "SELECT entity_id, name FROM entities WHERE doc_id = 'doc1'")
def entities_of_document(spark, sf_dir) -> DataFrame:
    return star_graph(spark, sf_dir)["entities"].where(tx.in_doc(F.col("entity_id"), "doc1")).select("entity_id", "name")


@query(
    SQL
    + """SELECT 'documents' AS name, 0::BIGINT AS rows UNION ALL SELECT 'evidence_deltas', 0 UNION ALL SELECT 'refresh_decisions', 0 UNION ALL SELECT 'sentences', count(*) FROM sentences UNION ALL SELECT 'entities', count(*) FROM entities
UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'sentence_supports_relation', count(*) FROM supports"""
)
def table_counts(spark, sf_dir) -> DataFrame:
    return pv.counts(star_graph(spark, sf_dir))


@query(AFFECTED + "SELECT relation_id, rel_type, status FROM relations WHERE relation_id IN (SELECT target_id FROM affected WHERE target_type = 'relation')")
def relations_by_ids(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir)
    ids = pv.affected(g, _edited(g)).where("target_type = 'relation'").select("target_id")
    return pv.by_ids(g["relations"], "relation_id", ids).select("relation_id", "rel_type", "status")


@query(SQL + "SELECT sent_id, doc_id FROM sentences WHERE sent_id IN (SELECT src FROM mentions WHERE status <> 'removed' UNION ALL SELECT src FROM supports WHERE status <> 'removed')")
def sentences_with_evidence(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir, pinned)
    return pv.with_evidence(g, g["sentences"].select("sent_id", "doc_id"))


@query(SQL + "SELECT edge_id, 'supplier ' || s || ' ' || rel_type || ' part ' || p || '.' AS query FROM supports JOIN sentences ON src = sent_id WHERE status <> 'removed'")
def fact_queries(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir, pinned)
    rows = pv.relation_triples(g, g["sentence_supports_relation"].where(pv.not_removed()))
    return rows.select("edge_id", tx.fact_query(F.col("head_name"), F.col("label"), F.col("tail_name")).alias("query"))


@query(
    SQL
    + """, ask AS (SELECT doc_id, min(p) AS p FROM sentences GROUP BY doc_id), live AS (SELECT src FROM mentions WHERE status <> 'removed' UNION SELECT src FROM supports WHERE status <> 'removed')
SELECT s.doc_id AS instruction_id, s.sent_id FROM sentences s JOIN ask a ON a.doc_id = s.doc_id JOIN live ON src = s.sent_id WHERE contains(s.text, 'part ' || a.p)"""
)
def related_by_evidence(spark, sf_dir) -> DataFrame:
    g = star_graph(spark, sf_dir, pinned)
    part = F.split(F.substring_index("sent_id", ":", -1), "-")[2].cast("long")
    ask = g["sentences"].groupBy("doc_id").agg(F.min(part).alias("p")).select(F.col("doc_id").alias("instruction_id"), "doc_id", F.concat(F.lit("remove part "), "p").alias("instruction"))
    return editor.select_by_evidence(g, pinned(ask))


@query(SQL + "SELECT sent_id, CASE l % 3 WHEN 0 THEN 'supplier ' || s || ' ships a new item.' WHEN 1 THEN 'supplier ' || s || ' ships .' ELSE text END AS new_text FROM sentences")
def rewritten_sentences(spark, sf_dir) -> DataFrame:
    ids = F.split(F.substring_index("sent_id", ":", -1), "-")
    part, kind = F.concat(F.lit("part "), ids[2]), ids[1].cast("int") % 3
    ask = F.when(kind == 0, F.concat(F.lit("Replace "), part, F.lit(" with a new item"))).when(kind == 1, F.concat(F.lit("please drop "), part)).otherwise("leave it")
    return star_graph(spark, sf_dir)["sentences"].select("sent_id", editor.rewrite(F.col("text"), ask).alias("new_text"))


@query(BATCH_SQL + "SELECT DISTINCT " + TARGET + ", target_id FROM decided WHERE decision <> 'SKIP'")
def marked_stale(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir, "deferred")[2].marked_stale.select("target_type", "target_id").distinct()


@query(BATCH_SQL + "SELECT seq AS edit_seq, " + TARGET + ", target_id, decision FROM decided")
def pending_decisions(spark, sf_dir) -> DataFrame:
    return pv.pending(_batch(spark, sf_dir, "deferred")[2].graph).select("edit_seq", "target_type", "target_id", "decision")


@query(BATCH_SQL + "SELECT 'applied' AS status, decision, count(*) AS n FROM decided GROUP BY decision")
def applied_decisions(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir)[2].graph["refresh_decisions"].groupBy("status", "decision").agg(F.count("*").alias("n"))


@query(BATCH_SQL + ", per AS (SELECT seq, sum(cost) AS cost, count(*) AS n FROM costed GROUP BY seq) SELECT e.seq AS edit_seq, e.sent_id, coalesce(cost, 0)::BIGINT AS this_step, (coalesce(n, 0) * 5)::BIGINT AS vs_full_rebuild FROM edits e LEFT JOIN per ON per.seq = e.seq")
def edit_costs(spark, sf_dir) -> DataFrame:
    rows = _batch(spark, sf_dir, "deferred")[2].edits
    return rows.select("edit_seq", "sent_id", F.col("this_step").cast("long").alias("this_step"), F.col("vs_full_rebuild").cast("long").alias("vs_full_rebuild"))


@query(
    BATCH_SQL
    + """, t AS (SELECT sent_id, CASE scenario WHEN 0 THEN 'supplier ' || s || ' ships part ' || p || '. ' WHEN 1 THEN 'removed' ELSE 'supplier ' || s || ' ships part ' || q || '.' END AS text FROM edits)
SELECT sent_id, text, sha1(text) AS text_hash FROM t"""
)
def edited_sentences(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir, "deferred")[2].graph["sentences"].where("last_changed_step = 1").select("sent_id", "text", "text_hash")


@query(
    EVENTS
    + """, c AS (SELECT user_id, count_if(decision = 'SKIP') AS skip, count_if(decision = 'PATCH') AS patch, count_if(decision = 'REBUILD') AS rebuild, sum(cost) AS ours, count(*) * 5 AS whole FROM log GROUP BY user_id)
SELECT user_id, round(skip / (skip + patch + rebuild), 6) AS skip_rate, round(patch / (skip + patch + rebuild), 6) AS patch_rate, round(rebuild / (skip + patch + rebuild), 6) AS rebuild_rate, round(1 - ours / whole, 6) AS cost_reduction FROM c"""
)
def decision_rates(spark, sf_dir) -> DataFrame:
    n = lambda d: F.count_if(F.col("decision") == d).alias(d.lower())
    sums = _log(spark, sf_dir).groupBy("user_id").agg(n("SKIP"), n("PATCH"), n("REBUILD"), F.sum("cost").alias("ours_cost"), (F.count("*") * 5).alias("full_rebuild_cost"))
    return evaluation.rates(sums).select("user_id", *(F.round(c, 6).alias(c) for c in ("skip_rate", "patch_rate", "rebuild_rate", "cost_reduction")))


@query("SELECT count(*) AS operations, round(avg((quality = 1)::INT), 9) AS good, round(avg((toxic = 0)::INT), 9) AS clean FROM labels")
def stage_accuracy(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean"))
    return evaluation.mean_flags(rows, "good", "clean").select("operations", F.round("good", 9).alias("good"), F.round("clean", 9).alias("clean"))


@query(
    """WITH s AS (SELECT doc_id, quality = 1 AS suggested FROM labels), r AS (SELECT doc_id, toxic = 1 AS seen FROM labels WHERE toxic = 1 OR quality = 0)
SELECT s.doc_id, coalesce(r.seen, s.suggested) AS human_should_edit, CASE WHEN r.doc_id IS NULL THEN '' ELSE 'note ' || r.doc_id END AS human_notes FROM s LEFT JOIN r ON r.doc_id = s.doc_id"""
)
def reviewed_labels(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    reviews = rows.where("toxic = 1 or quality = 0").select("doc_id", (F.col("toxic") == 1).alias("should_edit"), F.concat(F.lit("note "), "doc_id").alias("notes"))
    out = evaluation.reviewed(rows.select("doc_id", (F.col("quality") == 1).alias("suggested_should_edit")), reviews, "doc_id")
    return out.select("doc_id", "human_should_edit", "human_notes")


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS sentence_id FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_orderkey AS case_id, l_linenumber AS sentence_id, max(l_quantity)::DOUBLE AS score FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT case_id, sentence_id, e.case_id IS NOT NULL AS supports, score, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, sentence_id DESC) AS position FROM e FULL JOIN r USING (case_id, sentence_id)"""
)
def evidence_or_retrieved(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("sentence_id"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"))
    evidence = rows.where("l_returnflag = 'R'").select("case_id", "sentence_id").distinct()
    found = rows.where("l_linestatus = 'F'").groupBy("case_id", "sentence_id").agg(F.max("q").alias("score"))
    return evaluation.candidates(evidence, found).withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey, trim(p_name) || '|place of birth|' || trim(p_type) AS triples FROM part")
def canonical_triples(spark, sf_dir) -> DataFrame:
    t = lambda a, b, c: F.struct(a.alias("head"), F.lit(b).alias("rel_type"), c.alias("tail"))
    name, kind = F.col("p_name"), F.col("p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(t(F.concat(F.lit(" "), name), "born in", kind), t(F.lit(" "), "x", kind), t(name, "Place  of birth", kind), t(name, "birthplace", kind)).alias("triples"))
    out = ontology.canonicalize(rows, spark.createDataFrame([(0, "place of birth")], "position int, label string"), key="p_partkey")
    return out.select("p_partkey", F.array_join(F.transform("triples", lambda x: F.concat_ws("|", x["head"], x["rel_type"], x["tail"])), ";").alias("triples"))


@query("SELECT upper(p_type) AS source, p_type AS canonical, 'exact' AS method, 'accepted' AS status FROM part GROUP BY p_type")
def relation_match_exact(spark, sf_dir) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    got = ontology.match(types.select(F.upper("label").alias("source")), types.select(F.row_number().over(pv.Window.orderBy("label")).alias("position"), "label"))
    return got.select("source", "canonical", "method", "status")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN -p_size WHEN 3 THEN p_size * 100 ELSE 0 END::BIGINT AS n FROM part")
def lenient_integers(spark, sf_dir) -> DataFrame:
    kind, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(kind == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(kind == 1, F.concat(size, F.lit(".9"))).when(kind == 2, F.concat(F.lit("-"), size, F.lit(".5"))).when(kind == 3, F.concat(size, F.lit("e2"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.as_int(raw).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|is|' || trim(p_type) ELSE '' END AS triples FROM part")
def triples_from_json(spark, sf_dir) -> DataFrame:
    whole, kind = F.to_json(F.array(F.array("p_brand", F.lit(" is "), "p_type"), F.array("p_brand", F.lit(" "), "p_type"), F.array("p_brand", "p_type"))), F.col("p_partkey") % 3
    raw = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("["), whole)).otherwise(F.lit(None))
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.triples_of_json(raw).alias("t"))
    return rows.select("p_partkey", F.array_join(F.transform("t", lambda x: F.concat_ws("|", x["head"], x["rel_type"], x["tail"])), ";").alias("triples"))


@query(
    """WITH w AS (SELECT doc_id, text, regexp_extract(text, '([A-Za-z]{3,})', 1) AS w FROM documents)
SELECT doc_id, w <> '' AND regexp_matches(text, '(^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])' || w || '($|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])') AS whole_word FROM w"""
)
def phrase_in_text(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "([A-Za-z]{3,})", 1).alias("w"))
    return rows.select("doc_id", ((F.col("w") != "") & tx.phrase_occurs(F.col("text"), F.col("w"))).alias("whole_word"))


@query(
    """WITH a AS (SELECT doc_id, trim(regexp_replace(replace(text, ' ', '  '), '[ \\t\\n\\r\\f\\v]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(t, ',[ \\t\\n\\r\\f\\v]*,', ',', 'g'), '\\([ \\t\\n\\r\\f\\v]*\\)', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS cleaned FROM a"""
)
def cleaned_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(tx.cleanup(F.replace(F.col("text"), F.lit(" "), F.lit("  ")))).alias("cleaned"))


@query("SELECT count(embedding) AS embedded, max(len(embedding))::INTEGER AS dimension, greatest(1, least(count(embedding), round(15 * sqrt(count(embedding)))::BIGINT))::BIGINT AS lists FROM embeddings")
def embedding_counts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return retrieval.embedded(Graph({"sentences": rows})).select("embedded", "dimension", "lists")


@query(None)
def indexed_search(spark, sf_dir) -> DataFrame:
    """Every 20th vector against all rows, by the index; approximate, so without SQL."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    index = vector_index.build(rows, staging_path(spark))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_index.search(index, queries, key="vec_id", limit=10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
